import json
import random

from loomseries.operators import graph as gr
from loomseries.sources import graphs as gs


def edges_of(spark, graphs):
    rows = [(g, a, b) for g, pairs in graphs.items() for a, b in pairs]
    return spark.createDataFrame(rows, "graph string, src string, dst string")


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, "graph string, node string")


FLOWS = {
    "line": ["AB", "BC"],
    "ifelse": ["AB", "AC", "BD", "CD"],
    "while": ["AB", "BC", "CB", "BD"],
    "dowhile": ["AB", "BC", "CB", "CD"],
    "dead": ["AB", "XB"],
    "returns": ["AB", "AC"],
    "self": ["AB", "BB", "BC"],
    "crossed": ["AB", "BC", "CD", "BD", "DB", "DE"],
}
ENDS = {"line": "C", "ifelse": "D", "while": "D", "dowhile": "D", "dead": "B", "returns": "BC", "self": "C", "crossed": "E"}


def test_flows(spark):
    edges = edges_of(spark, FLOWS)
    entry = nodes_of(spark, [(g, "A") for g in FLOWS])
    levels = {(r.graph, r.node): r.level for r in gr.bfs_levels(edges, entry).collect()}
    assert levels["ifelse", "D"] == 2 and levels["while", "D"] == 2 and ("dead", "X") not in levels
    trimmed = {(r.graph, r.src + r.dst) for r in gr.trim_unreachable(edges, entry).collect()}
    assert ("dead", "XB") not in trimmed and ("dead", "AB") in trimmed
    ends = nodes_of(spark, [(g, n) for g, names in ENDS.items() for n in names])
    paths = gr.simple_paths(edges, entry, ends).collect()
    by_graph = {g: sorted("".join(r.nodes) for r in paths if r.graph == g) for g in FLOWS}
    assert by_graph["ifelse"] == ["ABD", "ACD"] and by_graph["while"] == ["ABD"] and by_graph["dowhile"] == ["ABCD"]
    assert by_graph["returns"] == ["AB", "AC"] and by_graph["crossed"] == ["ABCDE", "ABDE"]
    back = {(r.graph, r.src + r.dst) for r in gr.back_edges(edges, entry).collect()}
    assert back == {("while", "CB"), ("dowhile", "CB"), ("self", "BB"), ("crossed", "DB")}
    numbered = gs.numbered_paths(gr.simple_paths(edges, entry, ends))
    assert sorted(r.path_id for r in numbered.collect()) == list(range(1, len(paths) + 1))
    docs = {r.source_file: r for r in gs.path_documents(numbered).collect()}
    assert docs["crossed"].total_paths == 2 and docs["line"].paths[0].path == "A --> B --> C"


def test_closure_and_layers(spark):
    rng = random.Random(3)
    pairs = {(a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(16)) if a != b}
    edges = spark.createDataFrame([("g", a, b) for a, b in pairs], "graph string, src long, dst long")
    closure = set(pairs)
    while True:
        more = closure | {(a, d) for a, b in closure for c, d in pairs if b == c}
        if more == closure:
            break
        closure = more
    assert {(r.src, r.dst) for r in gr.transitive_closure(edges).collect()} == closure

    deps = edges_of(spark, {"g": ["AB", "AC", "BD", "CD"], "ring": ["AB", "BC", "CB", "DA"]})
    nodes = nodes_of(spark, [(g, n) for g in ("g", "ring") for n in "ABCD"])
    layers = {(r.graph, r.node): r.layer for r in gr.topological_layers(nodes, deps).collect()}
    assert [layers["g", n] for n in "DBCA"] == [0, 1, 1, 2]
    assert {layers["ring", n] for n in "ABCD"} == {0}  # nothing is free: all form the last layer


def test_contract_chains(spark):
    edges = edges_of(spark, {"g": ["AB", "BC", "CD", "CE", "DF", "EF", "FG"], "ring": ["AB", "BA"]})
    rows = [("g", n, n.lower(), n, 0, n == "G") for n in "ABCDEFG"] + [("ring", n, "t", n, 0, False) for n in "AB"]
    nodes = spark.createDataFrame(rows, "graph string, node string, type string, code string, cluster int, fixed boolean")
    kept, left = gr.contract_chains(nodes, edges)
    got = {(r.graph, r.node): (r.type, r.code, r.size) for r in kept.collect()}
    assert got["g", "C"] == ("a", "A\nB\nC", 3) and got["g", "G"] == ("g", "G", 1) and ("g", "A") not in got
    assert ("ring", "A") in got and ("ring", "B") in got
    assert {r.src + r.dst for r in left.filter("graph = 'g'").collect()} == {"CD", "CE", "DF", "EF", "FG"}


def test_spanning_forest(spark):
    rng = random.Random(8)
    pairs = {(a, b): rng.randrange(1, 20) for a in range(20) for b in range(a) if rng.random() < 0.2}
    df = spark.createDataFrame([(a, b, float(w)) for (a, b), w in pairs.items()], "a long, b long, weight double")
    got = [(r.a, r.b, r.weight) for r in gr.minimum_spanning_forest(df).collect()]
    parent = list(range(20))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total, count = 0, 0
    for (a, b), w in sorted(pairs.items(), key=lambda e: e[1]):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            total, count = total + w, count + 1
    assert len(got) == count and sum(w for *_, w in got) == total


def test_dot_files(spark, tmp_path):
    (tmp_path / "main.dot").write_text(
        'digraph "main" {\n  n1 [shape="invhouse"; label="START\\n  START"];\n'
        '  n2 [label="CONDITION\\n a[i] > 0"];\n  n3 [label="RETURN"];\n'
        '  n1 -> n2 [class="regular"; color="#2592a1"];\n  n2 -> n3 [class="consequence"];\n  n1 -> n3;\n}\n')
    statements = spark.read.option("wholetext", True).text(str(tmp_path)).selectExpr("'main' AS graph", "value AS statement")
    edges = {(r.src, r.dst): r.type for r in gs.parse_edges(statements, "statement").collect()}
    assert edges == {("n1", "n2"): "regular", ("n2", "n3"): "consequence", ("n1", "n3"): "regular"}
    nodes = {r.node: (r.type, r.label) for r in gs.parse_nodes(statements, "statement").collect()}
    assert nodes == {"n1": ("START", "START | START"), "n2": ("CONDITION", "CONDITION | a[i] > 0"), "n3": ("RETURN", "RETURN")}

    read = gs.read_dot(spark, str(tmp_path))
    assert {(r.graph, r.src, r.dst) for r in gs.parse_edges(read, "statement").collect()} == {("main", *e) for e in edges}
    assert {r.node: (r.type, r.label) for r in gs.parse_nodes(read, "statement").collect()} == nodes

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "main.json").write_text(json.dumps(
        {"source_file": "main.dot", "total_paths": 1, "paths": [{"path_id": 1, "path": "START --> RETURN"}]}, indent=2))
    assert [tuple(r) for r in gs.read_paths(spark, str(tmp_path / "docs")).collect()] == [("main", 1, "START --> RETURN")]

    made = edges_of(spark, {"g": ["AB", "BC"]})
    plain = spark.createDataFrame([("g", n, "STATEMENT", f'say "{n}"') for n in "ABC"], "graph string, node string, type string, code string")
    gs.write_dot(plain, made, str(tmp_path / "out"))
    assert (tmp_path / "out" / "g.dot").read_text().startswith('digraph "g" {\n')
    back = gs.read_dot(spark, str(tmp_path / "out"))
    assert {(r.src, r.dst) for r in gs.parse_edges(back, "statement").collect()} == {("nA", "nB"), ("nB", "nC")}
    assert {r.node for r in gs.parse_nodes(back, "statement").collect()} == {"nA", "nB", "nC"}


def plain_loops(pairs, entry):
    """Loops by a search with a stack, neighbours in order, the last one first."""
    stack, seen, found = [(entry, set())], set(), set()
    while stack:
        node, above = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        for child in sorted(b for a, b in pairs if a == node):
            if child in above or child == node:
                found.add((node, child))
            else:
                stack.append((child, above | {node}))
    return found


def test_loops_with_several_entries(spark):
    flows = {"two": ["EA", "EB", "AB", "BA"], "three": ["EA", "AB", "AC", "BC", "CD", "DB", "DX"], "mixed": ["EA", "EB", "AB", "BA", "BC", "CD", "DC", "DX"], "plain": ["EA", "AB", "BA", "BX"]}
    edges, entry = edges_of(spark, flows), nodes_of(spark, [(g, "E") for g in flows])
    got = {(r.graph, r.src, r.dst) for r in gr.back_edges(edges, entry).collect()}
    for g, pairs in flows.items():
        assert {(a, b) for name, a, b in got if name == g} == plain_loops([tuple(p) for p in pairs], "E"), g
    only = {(r.graph, r.src, r.dst) for r in gr.back_edges(edges, entry, tangled=False).collect()}
    assert only == {("mixed", "D", "C"), ("plain", "B", "A")}


def test_paths_walk_only_towards_ends(spark):
    dead = [("A", f"d{i}") for i in range(5)] + [(f"d{i}", f"d{j}") for i in range(5) for j in range(5) if i != j]
    edges = spark.createDataFrame([("g", a, b) for a, b in [*dead, ("A", "B"), ("B", "C")]], "graph string, src string, dst string")
    paths = gr.simple_paths(edges, nodes_of(spark, [("g", "A")]), nodes_of(spark, [("g", "C")]))
    assert [r.nodes for r in paths.collect()] == [["A", "B", "C"]]
    assert gr.simple_paths(edges, nodes_of(spark, [("g", "C")]), nodes_of(spark, [("g", "A")])).count() == 0


def test_path_documents_per_graph(spark, tmp_path):
    edges = edges_of(spark, {"f.dot": ["AB", "AC", "BD", "CD"], "g.dot": ["AD"]})
    starts, ends = nodes_of(spark, [("f.dot", "A"), ("g.dot", "A")]), nodes_of(spark, [("f.dot", "D"), ("g.dot", "D")])
    nodes = spark.createDataFrame(
        [(g, n, "START" if n == "A" else "STATEMENT", f"label {n}") for g in ("f.dot", "g.dot") for n in "ABD"], "graph string, node string, type string, label string")
    numbered = gs.document_paths(gr.simple_paths(edges, starts, ends), nodes)
    gs.write_documents(gs.path_documents(numbered), str(tmp_path / "docs"))
    gs.write_documents(gs.detailed_documents(numbered, starts, ends), str(tmp_path / "docs"), "_detailed")
    plain = json.loads((tmp_path / "docs" / "f.json").read_text())
    assert plain == {"source_file": "f.dot", "total_paths": 2, "paths": [
        {"path_id": 1, "path": "label A --> label B --> label D"}, {"path_id": 2, "path": "label A -->  --> label D"}]}
    full = json.loads((tmp_path / "docs" / "f_detailed.json").read_text())
    assert full["start_nodes"] == ["A"] and full["return_nodes"] == ["D"] and full["paths"][1]["length"] == 3
    assert full["paths"][1]["nodes"][1] == {"node_id": "C", "type": "UNKNOWN", "label": ""}
    assert json.loads((tmp_path / "docs" / "g.json").read_text())["paths"][0]["path_id"] == 1
