"""Nested graph text, written and read back."""

from loomseries.sources import clusters as cl

CODES = ['a];\nb -> c;', 'say "hi" \\n\n\ttab', "", "n2 [label=x];", "é\u2028日"]


def test_nested_clusters(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("g", i, "T", CODES[i], c) for i, c in enumerate(["in", "in", "out", None, "lost"])] + [("h", 0, "T", None, None)],
        "graph string, node int, type string, code string, cluster string")
    edges = spark.createDataFrame([("g", 0, 1), ("g", 1, 2), ("g", 2, 3), ("g", 2, 0), ("g", 3, 4)], "graph string, src int, dst int")
    clusters = spark.createDataFrame([("g", "out", None), ("g", "in", "out"), ("g", "ring", "ring")], "graph string, cluster string, parent string")
    entries = spark.createDataFrame([("g", 0)], "graph string, node int")
    cl.write_clusters(cl.clustered_statements(nodes, edges, clusters, entries), str(tmp_path / "dot"))
    assert [x.strip().split(" [")[0] for x in (tmp_path / "dot" / "g.dot").read_text().split("\n")[3:] if x] == [
        "n3", "n4", 'subgraph "cluster_out" {', "n2", 'subgraph "cluster_in" {', "n0", "n1", "n0 -> n1", "}", "n1 -> n2", "n0 -> n2", "}", "n2 -> n3", "n3 -> n4", "}"]
    read = cl.read_statements(spark, str(tmp_path / "dot"))
    got = {(r.graph, int(r.node)): (r.code, r.cluster) for r in cl.parse_nodes(read).collect()}
    assert got == {**{("g", i): (CODES[i], c) for i, c in enumerate(["in", "in", "out", None, "lost"])}, ("h", 0): ("", None)}
    assert sorted((int(r.src), int(r.dst), r.back) for r in cl.parse_edges(read).collect()) == [
        (0, 1, False), (1, 2, False), (2, 0, True), (2, 3, False), (3, 4, False)]
    assert (tmp_path / "dot" / "h.dot").read_text().startswith('digraph "h" {\n    node [shape="box"; style="filled"];\n')
