"""Graph text (DOT), execution paths, and their tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.numbering import global_rank
from .files import write_named

# The first of these words in a label gives the node its type.
NODE_TYPES = ["START", "RETURN", "CONDITION", "STATEMENT", "MERGE"]

PATHS = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("total_paths", T.LongType()),
    T.StructField("paths", T.ArrayType(T.StructType([
        T.StructField("path_id", T.LongType()), T.StructField("path", T.StringType())]))),
])


def read_dot(spark: SparkSession, path: str) -> DataFrame:
    """Statements ``(graph, statement)`` of the .dot files under ``path``; the graph is the file's stem.

    Files are cut where an attribute list ends a line, so a file need not fit
    into one row; a statement without attributes stays with the one after it.
    """
    lines = spark.read.option("lineSep", "];\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dot").text(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.dot$", 1)
    return lines.select(stem.alias("graph"), F.concat("value", F.lit("];")).alias("statement"))


def parse_edges(statements: DataFrame, text: str) -> DataFrame:
    """``(graph, src, dst, type)`` of the edges; an edge without a class is ``regular``."""
    found = F.regexp_extract_all(text, F.lit(r"(\w+\s*->\s*\w+\s*(?:\[[^\]]+\])?)\s*;"), F.lit(1))
    edges = statements.select("graph", F.explode(found).alias("_e"))
    kind = F.regexp_extract("_e", 'class="([^"]*)"', 1)
    return edges.select(
        "graph",
        F.regexp_extract("_e", r"^(\w+)", 1).alias("src"),
        F.regexp_extract("_e", r"->\s*(\w+)", 1).alias("dst"),
        F.when(kind == "", "regular").otherwise(kind).alias("type"),
    )


def parse_nodes(statements: DataFrame, text: str) -> DataFrame:
    """``(graph, node, label, type)``; the lines of a label are joined by ``|``."""
    found = F.regexp_extract_all(text, F.lit(r'(?s)(?:^|[;{}\n])\s*(\w+\s*\[(?:[^\]"]|"[^"]*")+\])\s*;'), F.lit(1))
    nodes = statements.select("graph", F.explode(found).alias("_n"))
    label = F.regexp_extract("_n", '(?s)label="([^"]*)"', 1)
    lines = F.filter(F.transform(F.split("label", r"\\n|\n"), lambda x: F.trim(x)), lambda x: x != "")
    kind = F.lit("UNKNOWN")
    for name in reversed(NODE_TYPES):
        kind = F.when(F.col("label").contains(name), name).otherwise(kind)
    return (
        nodes.select("graph", F.regexp_extract("_n", r"^(\w+)", 1).alias("node"), label.alias("label"))
        .withColumn("type", kind)
        .withColumn("label", F.array_join(lines, " | "))
    )


def edge_statements(edges: DataFrame) -> DataFrame:
    """One DOT statement per edge; edges with ``back`` set are written from target to source."""
    a, b = F.col("src").cast("string"), F.col("dst").cast("string")
    if "back" in edges.columns:
        a, b = F.when(F.col("back"), b).otherwise(a), F.when(F.col("back"), a).otherwise(b)
    kind = F.col("type") if "type" in edges.columns else F.lit("regular")
    text = F.format_string('    n%s -> n%s [class="%s"];', a, b, kind)
    return edges.select(F.col("graph").cast("string").alias("graph"), text.alias("statement"))


def node_statements(nodes: DataFrame) -> DataFrame:
    label = F.concat_ws("\\n", "type", F.regexp_replace("code", '["]', "'"))
    text = F.format_string('    n%s [shape="box"; label="%s"];', F.col("node").cast("string"), label)
    return nodes.select(F.col("graph").cast("string").alias("graph"), text.alias("statement"))


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One file ``<graph>.dot`` per graph, with its nodes and edges; a file is written by one task as it streams in."""
    graph = F.col("graph").cast("string")
    head = nodes.select(graph.alias("graph")).union(edges.select(graph)).distinct()
    parts = [
        head.select("graph", F.lit(0).alias("no"), F.format_string('digraph "%s" {', "graph").alias("statement")),
        node_statements(nodes).select("graph", F.lit(1).alias("no"), "statement"),
        edge_statements(edges).select("graph", F.lit(2).alias("no"), "statement"),
        head.select("graph", F.lit(3).alias("no"), F.lit("}").alias("statement")),
    ]
    every = reduce(DataFrame.unionByName, parts)
    write_named(every.select(
        F.concat("graph", F.lit(".dot")).alias("name"), F.struct("no", "statement").alias("no"), F.concat("statement", F.lit("\n")).alias("text")), path)


def numbered_paths(paths: DataFrame) -> DataFrame:
    """Number paths over all graphs in the order of their text, and join their nodes by arrows."""
    joined = paths.withColumn("path", F.array_join(F.transform("nodes", lambda n: n.cast("string")), " --> "))
    return global_rank(joined, "path", "graph", name="path_id")


def document_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``paths`` (graph, start, end, nodes) numbered per graph, with the type and label of each node.

    ``path_id`` counts from 1 by start, end and the nodes on the way, which is
    the order of a depth-first search that takes neighbours in their order.
    ``nodes`` is (graph, node, type, label). A graph's document holds all its
    paths, so numbering brings them together; that is its nature.
    """
    order = Window.partitionBy("graph").orderBy("start", "end", "nodes")
    numbered = paths.withColumn("path_id", F.row_number().over(order).cast("long"))
    steps = numbered.select("graph", "path_id", F.posexplode("nodes").alias("at", "node")).join(nodes, ["graph", "node"], "left")
    info = F.struct(
        "at", F.col("node").cast("string").alias("node_id"), F.coalesce("type", F.lit("UNKNOWN")).alias("type"), F.coalesce("label", F.lit("")).alias("label"))
    lists = steps.groupBy("graph", "path_id").agg(F.transform(
        F.sort_array(F.collect_list(info)), lambda x: F.struct(x["node_id"], x["type"], x["label"])).alias("steps"))
    return numbered.join(lists, ["graph", "path_id"]).select("graph", "path_id", "start", "end", "steps")


def path_documents(numbered: DataFrame) -> DataFrame:
    """One document per graph: ``(source_file, total_paths, paths)``, a path being the labels joined by arrows."""
    if "steps" in numbered.columns:
        numbered = numbered.withColumn("path", F.array_join(F.transform("steps", lambda x: x["label"]), " --> "))
    entry = F.struct("path_id", "path")
    return numbered.groupBy(F.col("graph").alias("source_file")).agg(
        F.count(F.lit(1)).alias("total_paths"), F.sort_array(F.collect_list(entry)).alias("paths"))


def detailed_documents(numbered: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """One document per graph with its start and return nodes, and of every path its length and its nodes' types and labels."""
    entry = F.struct(
        "path_id", F.col("start").cast("string").alias("start_node"), F.col("end").cast("string").alias("end_node"),
        F.size("steps").alias("length"), F.col("steps").alias("nodes"))
    docs = numbered.groupBy("graph").agg(F.count(F.lit(1)).alias("total_paths"), F.sort_array(F.collect_list(entry)).alias("paths"))

    def listed(nodes, name):
        return nodes.groupBy("graph").agg(F.transform(F.sort_array(F.collect_set("node")), lambda x: x.cast("string")).alias(name))

    met = docs.join(listed(starts, "start_nodes"), "graph").join(listed(ends, "return_nodes"), "graph")
    return met.select(F.col("graph").alias("source_file"), "total_paths", "start_nodes", "return_nodes", "paths")


def write_documents(documents: DataFrame, path: str, suffix: str = "") -> None:
    """One JSON file ``<source_file><suffix>.json`` per document."""
    stem = F.regexp_replace(F.col("source_file").cast("string"), r"\.dot$", "")
    write_named(documents.select(
        F.concat(stem, F.lit(f"{suffix}.json")).alias("name"), F.lit(0).alias("no"), F.to_json(F.struct("*")).alias("text")), path)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """``(name, path_id, path)`` of the path documents under ``path``; the name is the file's stem."""
    docs = spark.read.schema(PATHS).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return docs.select(stem.alias("name"), F.explode("paths").alias("p")).select("name", "p.*")
