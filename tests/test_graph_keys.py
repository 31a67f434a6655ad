"""NULL keys, deep graphs, and components of graphs."""

import random

from loomseries.operators import graph as gr
from loomseries.queries import graph_queries
from test_graph import edges_of, nodes_of, plain_loops

NULL_EDGES = [(None, "A", "B"), (None, "B", "C"), (None, "C", "B"), ("g", "A", "B"), ("g", "B", None), (None, None, "A")]


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_null_keys_are_keys(spark):
    edges = spark.createDataFrame(NULL_EDGES, "graph string, src string, dst string")
    entry = nodes_of(spark, [(None, "A"), ("g", "A")])
    assert pairs(gr.bfs_levels(edges, entry)) == sorted(
        [(None, "A", 0), (None, "B", 1), (None, "C", 2), ("g", "A", 0), ("g", "B", 1), ("g", None, 2)], key=str)
    assert gr.trim_unreachable(edges, entry).count() == 5
    closure = {(r.graph, r.src, r.dst) for r in gr.transitive_closure(edges).collect()}
    assert {(None, None, "C"), (None, "B", "B"), ("g", "A", None)} <= closure and len(closure) == 12
    paths = gr.simple_paths(edges, entry, nodes_of(spark, [(None, "C"), ("g", None)]))
    assert pairs(paths.select("graph", "nodes")) == [("g", ["A", "B", None]), (None, ["A", "B", "C"])]
    loops = gr.back_edges(edges, entry)
    assert pairs(loops) == [(None, "C", "B")]
    assert dict(gr.bfs_levels(edges, entry).dtypes) == {"graph": "string", "node": "string", "level": "bigint"}


def test_null_keys_in_layers_end(spark):
    depends = spark.createDataFrame([(None, "A", "B"), (None, "B", "C"), ("g", "A", None), ("h", "A", "B"), ("h", "B", "A")], "graph string, src string, dst string")
    nodes = nodes_of(spark, [(None, "A"), (None, "B"), (None, "C"), ("g", "A"), ("g", None), ("h", "A"), ("h", "B"), ("h", "C")])
    assert pairs(gr.topological_layers(nodes, depends)) == sorted(
        [(None, "A", 2), (None, "B", 1), (None, "C", 0), ("g", "A", 1), ("g", None, 0), ("h", "A", 1), ("h", "B", 1), ("h", "C", 0)], key=str)
    none = nodes.filter("graph = 'x'")
    assert gr.topological_layers(none, depends).count() == 0


def test_null_keys_in_chains(spark):
    edges = spark.createDataFrame([(None, "A", "B"), (None, "B", None)], "graph string, src string, dst string")
    rows = [(None, n, "t", n or "-", 0, False) for n in ("A", "B", None)]
    nodes = spark.createDataFrame(rows, "graph string, node string, type string, code string, cluster int, fixed boolean")
    kept, left = gr.contract_chains(nodes, edges)
    assert [tuple(r) for r in kept.collect()] == [(None, None, "t", "A\nB\n-", 3)] and left.count() == 0


def longest(nodes, needs):
    out = {}

    def layer(n):
        if n not in out:
            out[n] = max((layer(b) + 1 for a, b in needs if a == n), default=0)
        return out[n]

    return {n: layer(n) for n in nodes}


def test_layers_of_chains_and_meshes(spark, monkeypatch):
    rng = random.Random(6)
    mesh = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a > b}
    tails = {(100 + i, 99 + i) for i in range(1, 30)} | {(100, 20), (5, 115)}  # a long chain hung into the mesh
    needs = sorted(mesh | tails)
    nodes = sorted({x for p in needs for x in p} | {999})
    chain = [("chain", i + 1, i) for i in range(2000)]
    edges = spark.createDataFrame([("m", *p) for p in needs] + chain, "graph string, src long, dst long")
    every = spark.createDataFrame([("m", n) for n in nodes] + [("chain", n) for n in range(2001)], "graph string, node long")
    rounds = []
    real = gr.GrowingTable.append
    monkeypatch.setattr(gr.GrowingTable, "append", lambda self, df: (rounds.append(1), real(self, df))[1])
    got = {(r.graph, r.node): r.layer for r in gr.topological_layers(every, edges).collect()}
    want = longest(nodes, needs)
    assert {n: got["m", n] for n in nodes} == want
    assert [got["chain", n] for n in range(2001)] == list(range(2001))
    assert len(rounds) <= 2 * max(want.values()) + 4  # not one per node of a chain


def test_closure_doubles(spark, monkeypatch):
    chain = spark.createDataFrame([("g", i, i + 1) for i in range(200)], "graph string, src long, dst long")
    rounds = []
    real = gr.GrowingTable.append
    monkeypatch.setattr(gr.GrowingTable, "append", lambda self, df: (rounds.append(1), real(self, df))[1])
    closure = gr.transitive_closure(chain)
    assert closure.count() == 200 * 201 // 2 == closure.distinct().count()
    assert len(rounds) <= 10


def reach(edges):
    out = set(edges)
    while True:
        more = out | {(a, d) for a, b in out for c, d in edges if b == c}
        if more == out:
            return out
        out = more


def test_components_by_colours(spark):
    rng = random.Random(11)
    graphs = {g: {(rng.randrange(9), rng.randrange(9)) for _ in range(12)} for g in range(4)}
    edges = spark.createDataFrame([(g, a, b) for g, e in graphs.items() for a, b in e], "graph long, src long, dst long")
    got = {(r.graph, r.node): r.part for r in gr.strong_components(edges).collect()}
    for g, e in graphs.items():
        both, nodes = reach(e), {x for p in e for x in p}
        assert nodes == {n for h, n in got if h == g}
        for a in nodes:
            for b in nodes:
                assert (got[g, a] == got[g, b]) == (a == b or ((a, b) in both and (b, a) in both))


def test_loops_by_components(spark):
    flows = {"two": ["EA", "EB", "AB", "BA"], "three": ["EA", "AB", "AC", "BC", "CD", "DB", "DX"]}
    flows[None] = flows["two"]
    edges, entry = edges_of(spark, flows), nodes_of(spark, [(g, "E") for g in flows])
    got = {(r.graph, r.src, r.dst) for r in gr.back_edges(edges, entry).collect()}
    for g, e in flows.items():
        assert {(a, b) for name, a, b in got if name == g} == plain_loops([tuple(p) for p in e], "E"), g


def test_each_component_is_searched_by_itself(spark):
    """Two components, both entered at two nodes: each starts at the last of these, wherever a search of all would come from."""
    edges, entry = edges_of(spark, {"pair": ["EA", "EB", "AB", "BA", "BC", "AD", "CD", "DC", "DX"]}), nodes_of(spark, [("pair", "E")])
    assert {(r.src, r.dst) for r in gr.back_edges(edges, entry).collect()} == {("A", "B"), ("C", "D")}


def test_large_and_small_cores_alike(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(g, rng.randrange(9), rng.randrange(9)) for g in range(8) for _ in range(18)] + [(g, -1, rng.randrange(9)) for g in range(8) for _ in range(3)]
    edges = spark.createDataFrame(rows, "graph long, src long, dst long")
    entry = spark.createDataFrame([(g, -1) for g in range(8)], "graph long, node long")
    out = []
    for small in (0, 100_000):
        monkeypatch.setattr(gr, "SMALL_CORE", small)
        out.append(pairs(gr.back_edges(edges, entry)))
    assert out[0] == out[1] and len(out[0]) > 8


def dominated(rows, entries):
    """Edges (graph, src, dst) that are reached, and not without their target."""
    out = set()
    for g, a, b in rows:
        def reach(without):
            seen, todo = set(), [n for h, n in entries if h == g and n != without]
            while todo:
                n = todo.pop()
                if n not in seen:
                    seen.add(n)
                    todo += [y for h, x, y in rows if h == g and x == n and y != without]
            return seen
        if a in reach(-9) and (a == b or a not in reach(b)):
            out.add((g, a, b))
    return out


def test_loops_of_deep_graphs_take_no_rounds(spark, monkeypatch):
    rng = random.Random(13)
    rows = {("deep", i, i + 1) for i in range(40)} | {("deep", i, i + 2) for i in range(0, 40, 3)} | {("deep", i, i - 2) for i in range(2, 40, 5)}
    rows |= {(f"g{g}", rng.randrange(7), rng.randrange(7)) for g in range(12) for _ in range(12)}
    starts = [("deep", 0), ("none", 0)] + [(f"g{g}", n) for g in range(12) for n in (0, g % 3)]
    edges = spark.createDataFrame(sorted(rows), "graph string, src long, dst long")
    entries = spark.createDataFrame(starts, "graph string, node long")
    rounds, real = [], gr.GrowingTable.append
    monkeypatch.setattr(gr.GrowingTable, "append", lambda self, df: (rounds.append(1), real(self, df))[1])
    got = [tuple(r) for r in gr.back_edges(edges, entries, tangled=False).collect()]
    every = pairs(gr.back_edges(edges, entries))
    assert not rounds
    assert len(got) == len(set(got)) and set(got) == dominated(rows, starts) and len(got) > 8 and len(every) > len(got)
    # Some graphs by rounds of joins, the others each in a task.
    some = edges.filter("graph like 'g%'")
    counts = {r["count"] for r in some.groupBy("graph").count().collect()}
    monkeypatch.setattr(gr, "SMALL_CORE", min(counts))
    assert len(counts) > 1 and pairs(gr.back_edges(some, entries)) == [r for r in every if r[0] != "deep"] and rounds


def test_graphs_share_a_call_of_python(spark, monkeypatch):
    """Graphs that go on over batches, a NULL one and one of NaN: a stream of sorted rows, not a call for each graph."""
    rng = random.Random(14)
    names = [None, float("nan"), *map(float, range(20))]
    rows = [(g, rng.randrange(6), rng.randrange(6)) for g in names for _ in range(14)]
    edges = spark.createDataFrame(rows, "graph double, src long, dst long")
    entries = spark.createDataFrame([(g, n) for g in names for n in (0, 1, 99)], "graph double, node long")
    plans, real = [], gr.saved
    monkeypatch.setattr(gr, "saved", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, out = spark.conf.get(size), []
    try:
        for rows_at_once in ("4", "10000"):
            spark.conf.set(size, rows_at_once)
            out.append(pairs(gr.back_edges(edges, entries)))
    finally:
        spark.conf.set(size, before)
    assert any("MapInArrow" in p for p in plans) and not any("FlatMapGroups" in p for p in plans)
    want = []
    for name in names:
        own = sorted({(a, b) for g, a, b in rows if str(g) == str(name)})
        want += [(name, a, b) for a, b in gr._loops_of(own, {0, 1} & {a for a, _ in own}, True)]
    assert str(out[0]) == str(out[1]) == str(sorted(want, key=str)) and len(want) > 40


def test_edges_of_talks_read_texts_once(spark, tmp_path, monkeypatch):
    rows = [(1, t, "x" * n) for t, n in enumerate((10, 950, 200, 400, 299, 901, 20))] + [(2, 0, None), (2, 1, ""), (2, 1, ""), (None, 0, "a"), (3, None, "b"), (3, 4, "c"), (3, 5, "d")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plans, real = [], graph_queries.saved
    monkeypatch.setattr(graph_queries, "saved", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    got = pairs(graph_queries.talk_edges(spark, str(tmp_path), True))
    there = {(g, t) for g, t, _ in rows}
    want = [(g, t, to) for g, t, x in rows if t is not None for to, on in (
        (t + 1, True), (t + 2, x is not None and len(x) > 900), (t - 2, t >= 2 and x is not None and len(x) < 300))
        if on and g is not None and (g, to) in there]
    assert got == sorted(want, key=str) and len(got) == 12
    assert [p.count("text:string") for p in plans] == [1]
