"""What graph operators and ranks send through Spark's shuffles and sorts."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomseries.operators import graph as gr
from loomseries.operators import ordered_tree
from loomseries.plans.numbering import global_rank


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_are_boxed_only_for_nulls(spark):
    """The core gets plain keys unless one of them is NULL."""
    kinds = []
    run = gr.over_boxed_keys(lambda df: kinds.append(df.schema["src"].dataType.simpleString()) or df)
    rows = [("g", "a", "b"), ("g", None, "c")]
    for some in (rows[:1], rows):
        assert [tuple(r) for r in run(spark.createDataFrame(some, "graph string, src string, dst string")).collect()] == some
    assert kinds == ["string", "struct<_boxed:string>"]


def test_paths_through_ends(spark):
    """An end that lies on a path, one that goes on without reaching another, and a start that is an end."""
    edges = spark.createDataFrame([("g", *p) for p in ("ab", "bc", "cd", "de", "cf", "xy")], "graph string, src string, dst string")
    nodes = lambda names: spark.createDataFrame([("g", n) for n in names], "graph string, node string")
    got = sorted("".join(r.nodes) for r in gr.simple_paths(edges, nodes("ad"), nodes("bdx")).collect())
    assert got == ["ab", "abcd", "d"]
    assert gr.simple_paths(edges, nodes("e"), nodes("x")).count() == 0


def test_joins_sort_by_a_hash(spark):
    edges = spark.createDataFrame([("g", "a", "b")], "graph string, src string, dst string")
    entry = spark.createDataFrame([("g", "a")], "graph string, node string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin [_hash" in plan_of(gr.trim_unreachable(edges, entry))
        # The offsets of partitions are sent to the rows, not the rows to them.
        ranked = global_rank(spark.range(20).toDF("v"), "v")
        assert "BroadcastHashJoin" in plan_of(ranked) and sorted(r["rank"] for r in ranked.collect()) == list(range(1, 21))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ranges_join_by_one_number(spark, tmp_path):
    """Blocks of all levels, also before 0, meet by one number of level and block."""
    values = {i: i * i for i in range(-70, 90) if i % 3}
    data = spark.createDataFrame([(k, [v]) for k, v in values.items()], "p long, v array<long>")
    tree = ordered_tree.build(data, "p", "v", str(tmp_path / "t"), lambda x, y: x + y, (0,))
    asks = [(i, int(a), int(b)) for i, (a, b) in enumerate(np.random.default_rng(1).integers(-90, 100, (40, 2)))]
    out = tree.ranges(spark.createDataFrame(asks, "id long, a long, b long"), "id", "a", "b")
    assert "SortMergeJoin [level_block" in plan_of(out)
    assert {r.id: r.value[0] for r in out.collect()} == {i: sum(v for k, v in values.items() if a <= k <= b) for i, a, b in asks}


def lightest_forest(rows):
    """Kruskal over edges in the order of weight and ends, NULL first."""
    kinds, up, out = {}, {}, []
    for a, b, w in rows:
        if a != b:
            key = (min(a, b), max(a, b))
            known = [x for x in (kinds.get(key), w) if x is not None]
            kinds[key] = min(known, default=None)

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for (a, b), w in sorted(kinds.items(), key=lambda e: (e[1] is not None, e[1] or 0, e[0])):
        if root(a) != root(b):
            up[root(a)] = root(b)
            out.append((a, b, w))
    return sorted(out, key=str)


def test_forest_moves_numbers(spark, monkeypatch):
    """Many ties, copies and NULL weights: the same forest by hashes and by counted numbers, without a sort aggregate."""
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(150)]
    rows += [("x", "y", 2.0), ("y", "x", 1.0), ("z", "z", 1.0)]
    edges = spark.createDataFrame(rows, "a string, b string, weight double")
    plans, real = [], gr.saved
    monkeypatch.setattr(gr, "saved", lambda df: (plans.append(plan_of(df)), real(df))[1])
    want = lightest_forest(rows)
    assert sorted(map(tuple, gr.minimum_spanning_forest(edges).collect()), key=str) == want
    assert plans and not any("SortAggregate" in p for p in plans)
    monkeypatch.setattr(gr, "_short", lambda node: F.pmod(F.xxhash64(node), F.lit(3)))
    assert sorted(map(tuple, gr.minimum_spanning_forest(edges).collect()), key=str) == want
    assert gr.minimum_spanning_forest(edges.filter("a = b")).count() == 0
