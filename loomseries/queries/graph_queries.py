"""Graph operators on graphs derived from the tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..session import saved
from ..sources import graphs as gs
from .tables import rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


# One graph of the whole trade: region -> nation -> customer -> order -> supplier.
TRADE_SQL = """trade AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION
  SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION
  SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION
  SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem)"""


def _id(letter, column):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def trade(spark, d):
    hops = [
        ("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"),
        ("orders", "c", "o_custkey", "o", "o_orderkey"), ("lineitem", "o", "l_orderkey", "s", "l_suppkey"),
    ]
    parts = [
        table(spark, d, t).select(F.lit("trade").alias("graph"), _id(a, x).alias("src"), _id(b, y).alias("dst"))
        for t, a, x, b, y in hops
    ]
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    return edges.distinct()


def _entry(spark, node):
    return spark.createDataFrame([("trade", node)], "graph string, node string")


@query("graph_levels", f"""WITH RECURSIVE {TRADE_SQL}, b AS (SELECT 'r0' AS node, CAST(0 AS BIGINT) AS level UNION
  SELECT dst, level + 1 FROM b JOIN trade ON src = node) SELECT node, min(level) AS level FROM b GROUP BY node""")
def graph_levels(spark, d):
    return gr.bfs_levels(trade(spark, d), _entry(spark, "r0")).select("node", "level")


@query("graph_trimmed", f"""WITH RECURSIVE {TRADE_SQL}, b AS (SELECT 'r0' AS node UNION SELECT dst FROM b JOIN trade ON src = node)
  SELECT src, dst FROM trade WHERE src IN (SELECT node FROM b)""")
def graph_trimmed(spark, d):
    return gr.trim_unreachable(trade(spark, d), _entry(spark, "r0")).select("src", "dst")


@query("graph_closure", f"""WITH RECURSIVE {TRADE_SQL}, 
  b AS (SELECT src, dst FROM trade UNION SELECT b.src, t.dst FROM b JOIN trade t ON t.src = b.dst) SELECT src, dst FROM b""")
def graph_closure(spark, d):
    return gr.transitive_closure(trade(spark, d)).select("src", "dst")


@query("graph_paths", f"""WITH RECURSIVE {TRADE_SQL}, p AS (SELECT 'r' || r_regionkey AS last, 'r' || r_regionkey AS path FROM region UNION ALL
  SELECT dst, path || ' --> ' || dst FROM p JOIN trade ON src = last)
  SELECT row_number() OVER (ORDER BY path) AS path_id, path FROM p WHERE last[1] = 's'""")
def graph_paths(spark, d):
    starts = table(spark, d, "region").select(F.lit("trade").alias("graph"), _id("r", "r_regionkey").alias("node"))
    ends = table(spark, d, "supplier").select(F.lit("trade").alias("graph"), _id("s", "s_suppkey").alias("node"))
    return gs.numbered_paths(gr.simple_paths(trade(spark, d), starts, ends)).select("path_id", "path")


@query("graph_layers", f"""WITH RECURSIVE {TRADE_SQL}, b AS (SELECT DISTINCT dst AS node, CAST(0 AS BIGINT) AS layer FROM trade
  WHERE dst NOT IN (SELECT src FROM trade) UNION SELECT src, layer + 1 FROM b JOIN trade ON dst = node)
  SELECT node, max(layer) AS layer FROM b GROUP BY node""")
def graph_layers(spark, d):
    edges = trade(spark, d)
    nodes = edges.select("graph", F.col("src").alias("node")).union(edges.select("graph", "dst")).distinct()
    return gr.topological_layers(nodes, edges).select("node", "layer")


# One graph per conversation: turns follow each other, long turns also skip one, and a later turn may go back.
TALK_SQL = """flow AS (SELECT t.conv_id, t.turn AS src, u.turn AS dst FROM conversations t JOIN conversations u ON u.conv_id = t.conv_id
  AND (u.turn = t.turn + 1 OR (u.turn = t.turn + 2 AND length(t.text) > 900)))"""


def talk_edges(spark, d, loops: bool = False):
    """The edges as a table: texts are read once, for their lengths, however often the edges are."""
    talk = table(spark, d, "conversations").select(F.col("conv_id").alias("graph"), "turn", F.length("text").alias("n"))
    ends = [F.col("turn") + 1, F.when(F.col("n") > 900, F.col("turn") + 2)]
    if loops:
        ends.append(F.when((F.col("turn") >= 2) & (F.col("n") < 300), F.col("turn") - 2))
    edges = talk.select("graph", F.col("turn").alias("src"), F.explode(F.array(*ends)).alias("dst")).filter("dst is not null")
    known = talk.select("graph", F.col("turn").alias("dst"))
    return saved(edges.join(known, ["graph", "dst"], "left_semi").select("graph", "src", "dst"))


BACK_SQL = """WITH RECURSIVE """ + TALK_SQL + """, e AS (SELECT * FROM flow UNION SELECT conv_id, turn, turn - 2 FROM conversations
  WHERE turn >= 2 AND length(text) < 300),
  c AS (SELECT DISTINCT conv_id, src, dst FROM e WHERE dst <= src),
  b AS (SELECT DISTINCT conv_id, dst AS head, CAST(0 AS BIGINT) AS node FROM c WHERE dst <> 0
    UNION SELECT b.conv_id, head, e.dst FROM b JOIN e ON e.conv_id = b.conv_id AND e.src = b.node AND e.dst <> head)"""


@query("graph_back_edges", BACK_SQL + """  SELECT conv_id, src, dst FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.conv_id = c.conv_id AND b.head = c.dst AND b.node = c.src)""")
def graph_back_edges(spark, d):
    entries = table(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("graph"), F.col("turn").alias("node"))
    return gr.back_edges(talk_edges(spark, d, True), entries, tangled=False).select(F.col("graph").alias("conv_id"), "src", "dst")


# Cycles with several entries: components by reachability both ways, each searched with a stack as one state of a recursion.
LOOPS_SQL = BACK_SQL + """, l AS (SELECT conv_id, src, dst FROM c
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.conv_id = c.conv_id AND b.head = c.dst AND b.node = c.src)),
  r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS node FROM conversations WHERE turn = 0
    UNION SELECT r.conv_id, e.dst FROM r JOIN e ON e.conv_id = r.conv_id AND e.src = r.node),
  k AS (SELECT conv_id, src, dst FROM e SEMI JOIN r ON r.conv_id = e.conv_id AND r.node = e.src EXCEPT SELECT * FROM l),
  p AS (SELECT * FROM k UNION SELECT p.conv_id, p.src, k.dst FROM p JOIN k ON k.conv_id = p.conv_id AND k.src = p.dst),
  part AS (SELECT p.conv_id, p.src AS node, min(p.dst) AS part FROM p JOIN p q ON q.conv_id = p.conv_id AND q.src = p.dst AND q.dst = p.src GROUP BY ALL),
  inner_ AS (SELECT k.conv_id, a.part, src, dst FROM k JOIN part a ON a.conv_id = k.conv_id AND a.node = src
    JOIN part z ON z.conv_id = k.conv_id AND z.node = dst WHERE a.part = z.part),
  near AS (SELECT conv_id, part, src, list(dst ORDER BY dst) AS next FROM inner_ GROUP BY ALL),
  roots AS (SELECT conv_id, dst FROM (SELECT * FROM k EXCEPT SELECT conv_id, src, dst FROM inner_) UNION SELECT DISTINCT conv_id, 0 FROM conversations WHERE turn = 0),
  start AS (SELECT roots.conv_id, part, list({'n': dst, 'd': CAST(0 AS BIGINT)} ORDER BY dst) AS stack
    FROM roots JOIN part ON part.conv_id = roots.conv_id AND node = dst GROUP BY ALL),
  search AS (SELECT conv_id, part, stack, CAST([] AS BIGINT[]) AS path, CAST([] AS BIGINT[]) AS seen, CAST([] AS BIGINT[][]) AS found FROM start
    UNION ALL SELECT s.conv_id, s.part,
      stack[:-2] || list_transform(list_filter(fresh, lambda x: NOT list_contains(path[:top.d] || [top.n], x)), lambda x: {'n': x, 'd': top.d + 1}),
      path[:top.d] || [top.n], seen || [top.n],
      found || list_transform(list_filter(fresh, lambda x: list_contains(path[:top.d] || [top.n], x)), lambda x: [top.n, x])
    FROM (SELECT search.*, stack[-1] AS top, CASE WHEN list_contains(seen, stack[-1].n) THEN [] ELSE next END AS fresh
      FROM search JOIN near ON near.conv_id = search.conv_id AND near.part = search.part AND near.src = stack[-1].n) s)
  SELECT conv_id, src, dst FROM l UNION SELECT conv_id, f[1], f[2] FROM (SELECT conv_id, unnest(found) AS f FROM search)"""


@query("graph_loops", LOOPS_SQL)
def graph_loops(spark, d):
    """With the loops of cycles that have several entries, which depend on a search order."""
    entries = table(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("graph"), F.col("turn").alias("node"))
    return gr.back_edges(talk_edges(spark, d, True), entries).select(F.col("graph").alias("conv_id"), "src", "dst")


CHAIN_SQL = TALK_SQL + """, o AS (SELECT conv_id, src, count(*) AS n FROM flow GROUP BY ALL), i AS (SELECT conv_id, dst, count(*) AS n FROM flow GROUP BY ALL),
  link AS (SELECT conv_id, dst AS turn FROM flow JOIN o USING (conv_id, src) JOIN i USING (conv_id, dst) WHERE o.n = 1 AND i.n = 1),
  t AS (SELECT c.*, sum(CASE WHEN l.turn IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS blk
    FROM conversations c LEFT JOIN link l USING (conv_id, turn))"""


def _talk_nodes(spark, d):
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("graph"), F.col("turn").alias("node"), F.col("role").alias("type"),
        F.col("text").alias("code"), F.lit(0).alias("cluster"), F.lit(False).alias("fixed"))


@query("graph_contracted_nodes", f"""WITH {CHAIN_SQL} SELECT conv_id, max(turn) AS node, first(role ORDER BY turn) AS type,
  string_agg(text, chr(10) ORDER BY turn) AS code, count(*) AS size FROM t GROUP BY conv_id, blk""")
def graph_contracted_nodes(spark, d):
    nodes, _ = gr.contract_chains(_talk_nodes(spark, d), talk_edges(spark, d))
    return nodes.withColumnRenamed("graph", "conv_id")


@query("graph_contracted_edges", f"""WITH {CHAIN_SQL}, m AS (SELECT conv_id, blk, max(turn) AS stay FROM t GROUP BY ALL)
  SELECT DISTINCT f.conv_id, ms.stay AS src, md.stay AS dst FROM flow f JOIN t a ON a.conv_id = f.conv_id AND a.turn = f.src
  JOIN t b ON b.conv_id = f.conv_id AND b.turn = f.dst JOIN m ms ON ms.conv_id = f.conv_id AND ms.blk = a.blk
  JOIN m md ON md.conv_id = f.conv_id AND md.blk = b.blk WHERE a.blk <> b.blk""")
def graph_contracted_edges(spark, d):
    _, edges = gr.contract_chains(_talk_nodes(spark, d), talk_edges(spark, d))
    return edges.withColumnRenamed("graph", "conv_id")


@query("graph_dot_round_trip", f"WITH {TALK_SQL} SELECT CAST(conv_id AS VARCHAR) AS graph, 'n' || src AS src, 'n' || dst AS dst FROM flow")
def graph_dot_round_trip(spark, d):
    """Edges written as DOT statements and read back."""
    return gs.parse_edges(gs.edge_statements(talk_edges(spark, d)), "statement").select("graph", "src", "dst")


@query("graph_node_labels", """SELECT CAST(conv_id AS VARCHAR) AS graph, 'n' || turn AS node, CASE WHEN turn = 0 THEN 'START' WHEN role = 'assistant' THEN 'STATEMENT' ELSE 'CONDITION' END AS type
  FROM conversations""")
def graph_node_labels(spark, d):
    """Node types recovered from the labels of DOT statements."""
    kind = F.when(F.col("turn") == 0, "START").when(F.col("role") == "assistant", "STATEMENT").otherwise("CONDITION")
    nodes = table(spark, d, "conversations").select(
        F.col("conv_id").alias("graph"), F.col("turn").alias("node"), kind.alias("type"), F.col("text").alias("code"))
    return gs.parse_nodes(gs.node_statements(nodes), "statement").select("graph", "node", "type")


# One tree after the other, each from its smallest node, by the lightest edge out of what is joined so far.
@query("spanning_forest", """WITH RECURSIVE pairs AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, min(l_extendedprice) AS w FROM lineitem GROUP BY ALL),
  e AS (SELECT a AS x, b AS y, a, b, w FROM pairs UNION ALL SELECT b, a, a, b, w FROM pairs),
  t(node, a, b, w) USING KEY (node) AS (SELECT min(x), NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE FROM e UNION SELECT * FROM (
    SELECT y, a, b, w FROM e WHERE x IN (SELECT node FROM recurring.t) AND y NOT IN (SELECT node FROM recurring.t)
    UNION ALL SELECT min(x), NULL, NULL, NULL FROM e WHERE x NOT IN (SELECT node FROM recurring.t) HAVING count(*) > 0 ORDER BY w NULLS LAST, a, b LIMIT 1))
  SELECT a, b, round(w, 2) AS weight FROM t WHERE a IS NOT NULL""")
def spanning_forest(spark, d):
    edges = table(spark, d, "lineitem").select(
        _id("p", "l_partkey").alias("a"), _id("s", "l_suppkey").alias("b"), F.col("l_extendedprice").alias("weight"))
    return rounded(gr.minimum_spanning_forest(edges), ["weight"], 2)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
