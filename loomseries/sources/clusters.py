"""Graph text (DOT) with nested clusters, one statement a line, and codes that are read back unchanged.

A tree of clusters is flattened into statements with an order key: the clusters
on the way down, then the statement's kind. Sorted by it, a cluster's opening
comes before its nodes, these before the clusters inside it, its edges and its
end, so a file is written as it streams in, however large a cluster is.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..plans.numbering import matched
from ..session import saved
from .files import write_named

OPEN, NODE, INNER, EDGE, CLOSE = range(5)
DEFAULTS = {"node": {"shape": "box", "style": "filled"}, "edge": {"color": "#2592a1"}}
CODE = r'(?s)^\s*n(\S*) \[group="([^"]*)"; type="([^"]*)"; label=(".*")\];$'
EDGE_LINE = r'(?s)^\s*n(\S*) -> n(\S*) \[class="([^"]*)"\];$'


def quoted(text: Column) -> Column:
    """A text in quotes, with quotes, backslashes and line ends escaped as in JSON, so that it stays on its line."""
    whole = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def unquoted(text: Column) -> Column:
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]


def _step(kind: int, ident: Column | str = "") -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(ident) if isinstance(ident, str) else ident).alias("id"))


def cluster_ways(clusters: DataFrame) -> DataFrame:
    """(graph, cluster, way): the clusters from the top down to each of ``(graph, cluster, parent)``; as many rounds as levels.

    Clusters under a ring of parents, or under an unknown one, are left out.
    """
    text = clusters.select(*[F.col(c).cast("string").alias(c) for c in ("graph", "cluster", "parent")])
    text = saved(text)
    front = saved(text.where("parent is null").select("graph", "cluster", F.array(_step(INNER, F.col("cluster"))).alias("way")))
    found = front
    while not front.isEmpty():
        above = front.select("graph", F.col("cluster").alias("parent"), F.col("way").alias("_way"))
        below = matched(text.where("parent is not null"), above, ["graph", "parent"])
        front = saved(below.select("graph", "cluster", F.concat("_way", F.array(_step(INNER, F.col("cluster")))).alias("way")))
        found = found.unionByName(front)
    return found


def _attributes(values: Mapping[str, str]) -> str:
    return "; ".join(f'{k}="{v}"' for k, v in values.items())


def clustered_statements(
    nodes: DataFrame, edges: DataFrame, clusters: DataFrame, entries: DataFrame | None = None, defaults: Mapping[str, Mapping[str, str]] = DEFAULTS
) -> DataFrame:
    """(graph, no, statement): ``nodes`` (graph, node, type, code, cluster), ``edges`` (graph, src, dst), ``clusters`` (graph, cluster, parent).

    A node without a cluster, or in an unknown one, stands at the top. An edge
    stands in the innermost cluster that holds both its ends. With ``entries``
    (graph, node) the loops of the graph are found, and their edges are written
    from target to source, with the class ``back``.
    """
    back = gr.back_edges(edges.select("graph", "src", "dst"), entries) if entries is not None else edges.select("graph", "src", "dst").limit(0)
    links = matched(edges.select("graph", "src", "dst").distinct(), back.select("graph", "src", "dst", F.lit(True).alias("back")), ["graph", "src", "dst"], "left")
    links = links.select(*[F.col(c).cast("string").alias(c) for c in ("graph", "src", "dst")], F.coalesce("back", F.lit(False)).alias("back"))
    places = nodes.select(*[F.col(c).cast("string").alias(c) for c in ("graph", "node", "type", "code", "cluster")])
    ways = saved(cluster_ways(clusters))
    top = F.array().cast(ways.schema["way"].dataType)
    located = saved(matched(places, ways, ["graph", "cluster"], "left").withColumn("way", F.coalesce("way", top)))
    ends = located.select("graph", "node", "way").dropDuplicates(["graph", "node"])
    met = matched(links, ends.select("graph", F.col("node").alias("src"), F.col("way").alias("_a")), ["graph", "src"], "left")
    met = matched(met, ends.select("graph", F.col("node").alias("dst"), F.col("way").alias("_b")), ["graph", "dst"], "left")
    a, b = F.coalesce("_a", top), F.coalesce("_b", top)
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))
    common = F.when((F.size(a) == 0) | (F.size(b) == 0), top).otherwise(F.slice(a, 1, shared))
    source, target = F.when(F.col("back"), F.col("dst")).otherwise(F.col("src")), F.when(F.col("back"), F.col("src")).otherwise(F.col("dst"))

    def made(df: DataFrame, way: Column, last: Column, statement: Column) -> DataFrame:
        pad = F.repeat(F.lit("    "), F.size(way) + 1)
        return df.select("graph", F.concat(way, F.array(last)).alias("no"), F.concat(pad, statement).alias("statement"))

    heads = located.select("graph").union(links.select("graph")).distinct()
    begin = [F.format_string("digraph %s {", quoted(F.col("graph")))] + [F.lit(f"    {k} [{_attributes(v)}];") for k, v in defaults.items()]
    outer = heads.select("graph", F.explode(F.array(
        *[F.struct(F.array(_step(OPEN, f"{i:03}")).alias("no"), s.alias("statement")) for i, s in enumerate(begin)],
        F.struct(F.array(_step(CLOSE)).alias("no"), F.lit("}").alias("statement")))).alias("x")).select("graph", "x.*")
    upto = F.slice("way", 1, F.size("way") - 1)
    inner = [
        ways.select("graph", F.concat("way", F.array(_step(kind))).alias("no"), F.concat(F.repeat(F.lit("    "), F.size(upto) + 1), text).alias("statement"))
        for kind, text in ((OPEN, F.concat(F.lit("subgraph "), quoted(F.concat(F.lit("cluster_"), F.col("cluster"))), F.lit(" {"))), (CLOSE, F.lit("}")))]
    group = F.regexp_replace(F.coalesce("cluster", F.lit("")), '"', "'")
    node = F.concat(
        F.lit("n"), F.coalesce("node", F.lit("")), F.lit(' [group="'), group, F.lit('"; type="'), F.coalesce("type", F.lit("")), F.lit('"; label='),
        quoted(F.col("code")), F.lit("];"))
    edge = F.concat(F.lit("n"), source, F.lit(" -> n"), target, F.lit(' [class="'), F.when(F.col("back"), "back").otherwise("regular"), F.lit('"];'))
    parts = [
        outer, *inner, made(located, F.col("way"), _step(NODE, F.coalesce("node", F.lit(""))), node),
        made(met, common, _step(EDGE, F.concat("src", F.lit(" "), "dst")), edge)]
    return reduce(DataFrame.unionByName, parts)


def write_clusters(statements: DataFrame, path: str) -> None:
    """One file ``<graph>.dot`` per graph; its statements stream through one task in order."""
    write_named(statements.select(F.concat("graph", F.lit(".dot")).alias("name"), "no", F.concat("statement", F.lit("\n")).alias("text")), path)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(graph, statement) of files that hold a statement a line."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dot").text(path)
    return lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.dot$", 1).alias("graph"), F.col("value").alias("statement"))


def parse_nodes(statements: DataFrame) -> DataFrame:
    """(graph, node, type, code, cluster) as written; a cluster of '' is none."""
    part = lambda i: F.regexp_extract("statement", CODE, i)
    return statements.where(F.col("statement").rlike(CODE)).select(
        "graph", part(1).alias("node"), part(3).alias("type"), unquoted(part(4)).alias("code"), F.nullif(part(2), F.lit("")).alias("cluster"))


def parse_edges(statements: DataFrame) -> DataFrame:
    """(graph, src, dst, back): edges of loops are turned round again."""
    part = lambda i: F.regexp_extract("statement", EDGE_LINE, i)
    back = part(3) == "back"
    return statements.where(F.col("statement").rlike(EDGE_LINE)).select(
        "graph", F.when(back, part(2)).otherwise(part(1)).alias("src"), F.when(back, part(1)).otherwise(part(2)).alias("dst"), back.alias("back"))
