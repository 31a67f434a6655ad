"""Graphs over vectors, and indexes written and read again."""

import numpy as np
import pyarrow as pa

from loomseries.operators import vector_graph as vg
from loomseries.operators import vector_index as vi
from test_vector_index import exact, found, rows


def units(n, seed=3, dims=24):
    v = np.random.default_rng(seed).normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_all_rows_hang_together_and_links_go_both_ways():
    v = units(300)
    v[100:250] = v[99]  # a large group of copies
    v[250:255] = v[0]
    links = vg.link(v, 6)
    pairs = {(a, int(b)) for a, to in enumerate(links) for b in to}
    assert all((b, a) in pairs and a != b for a, b in pairs)
    reached, todo = {0}, [0]
    while todo:
        for b in links[todo.pop()].tolist():
            if b not in reached:
                reached.add(b)
                todo.append(b)
    assert len(reached) == 300


def test_walks_find_most_with_few_comparisons():
    v = units(2000, dims=12)
    graph = vg.neighbours(pa.array(vg.link(v), pa.list_(pa.int32())))
    queries = units(100, seed=9, dims=12)
    at, near, compared = vg.walk(v, graph, queries, 5, 40)
    want = np.argsort(-(queries @ v.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(at.tolist(), want.tolist(), strict=True)]) / 5 >= 0.9
    assert compared.mean() < 700
    assert np.allclose(near, np.take_along_axis(queries @ v.T, at, 1))


def test_small_blocks():
    for n in (1, 2, 3):
        v = units(n)
        graph = vg.neighbours(pa.array(vg.link(v), pa.list_(pa.int32())))
        at, _, compared = vg.walk(v, graph, v, 5, 12)
        assert sorted(at[0][at[0] >= 0].tolist()) == list(range(n)) and compared.tolist() == [n] * n


def test_graph_index(spark):
    data = rows(900)
    df = spark.createDataFrame(data, "id long, v array<double>").repartition(4)
    asked = list(range(0, 900, 50))
    want = exact(data[:900], asked, 5)
    index = vi.with_graphs(vi.build(df, "id", "v", lists=3, block=150))
    assert index.rows.count() == 900 and index.rows.groupBy("list", "block").count().agg({"count": "max"}).first()[0] < 300
    queries = df.where("id % 50 = 0 and id < 900")
    some = vi.search(index, queries, "id", "v", 5, 3)
    hit = sum(len(set(ids) & set(want[q])) for q, ids in found(some).items())
    assert hit / (5 * len(asked)) >= 0.9
    assert some.agg({"compared": "avg"}).first()[0] < 700


def test_saved_index_reads_probed_lists_only(spark, tmp_path):
    data = rows(600)
    df = spark.createDataFrame([(i, v, f"name {i}") for i, v in data], "id long, v array<double>, name string")
    index = vi.build(df, "id", "v", lists=12, keep=["name"])
    path = str(tmp_path / "index")
    vi.save(index, path)
    again = vi.load(spark, path)
    assert np.allclose(again.centres, index.centres) and again.rows.count() == 600
    queries = df.where("id % 50 = 0 and id < 600")
    out = vi.search(again, queries, "id", "v", 5, 12, keep=["name"])
    assert found(out) == exact(data[:600], list(range(0, 600, 50)), 5)
    assert all(r.name == f"name {r.id}" and r.compared == 600 for r in out.collect())
    few = vi.search(again, queries.where("id = 50"), "id", "v", 5, 2)
    assert few.count() == 5 and few.first().compared < 300
    plan = vi.probed_rows(again, [1, 4])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list", "[list")
    read = {f.split("list=")[1].split("/")[0] for f in vi.probed_rows(again, [1, 4]).select("list", "id").distinct().inputFiles()}
    assert len(read) == 12  # the table has all folders; the filter above picks those of two lists
    assert {r.list for r in vi.probed_rows(again, [1, 4]).select("list").distinct().collect()} == {1, 4}


def test_empty_index_is_saved(spark, tmp_path):
    df = spark.createDataFrame([], "id long, v array<double>")
    vi.save(vi.build(df, "id", "v"), str(tmp_path / "none"))
    again = vi.load(spark, str(tmp_path / "none"))
    assert vi.search(again, df, "id", "v", 5, 3).count() == 0
