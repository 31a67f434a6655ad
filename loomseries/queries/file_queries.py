"""Files written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph as gr
from ..plans.numbering import global_rank
from ..session import scratch_path
from ..sources import clusters, files
from ..sources import graphs as gs
from .graph_queries import TALK_SQL, talk_edges
from .record_queries import WORDS_SQL
from .tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(run):
        QUERIES[name], SQL[name] = run, sql
        return run

    return register


@query("source_files", """SELECT 'item_' || item_id || '.c' AS name, text FROM benchmark""")
def source_files(spark, d):
    folder = scratch_path(spark, "files")
    items = table(spark, d, "benchmark").select(
        F.format_string("item_%d.c", "item_id").alias("name"), F.lit(0).alias("no"), "text")
    files.write_named(items, folder)
    return files.read_sources(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "text")


@query("call_log_round_trip", """SELECT conv_id AS id, role, text AS content, length(text)::BIGINT AS tokens FROM conversations""")
def call_log_round_trip(spark, d):
    folder = scratch_path(spark, "files")
    talk = table(spark, d, "conversations")
    fields = {f.name: F.lit(None).cast(f.dataType) for f in files.CALL_LOG["request"].dataType}
    fields |= {"messages": F.array(F.struct("role", F.col("text").alias("content"))), "input_tokens": F.length("text").cast("long")}
    request = F.struct(*[v.alias(k) for k, v in fields.items()])
    for part in ("turn % 2 = 0", "turn % 2 <> 0"):
        files.append_call_log(talk.filter(part).select(F.col("conv_id").cast("string").alias("timestamp"), request.alias("request")), folder)
    log = files.read_call_log(spark, folder, lines=True)
    message = F.col("request.messages")[0]
    return log.select(
        F.col("timestamp").cast("long").alias("id"), message["role"].alias("role"), message["content"].alias("content"),
        F.col("request.input_tokens").alias("tokens"))


@query("count_csv_round_trip", "SELECT event_type AS subject, count(*) AS path_count FROM events GROUP BY 1")
def count_csv_round_trip(spark, d):
    folder = scratch_path(spark, "files")
    files.write_counts(table(spark, d, "events").groupBy(F.col("event_type").alias("subject")).agg(F.count(F.lit(1)).alias("path_count")), folder)
    return spark.read.schema("subject string, path_count long").csv(folder, header=True)


@query("matrix_text_round_trip", """SELECT array_to_string(list_transform(embedding, lambda x: printf('%.4g', x::DOUBLE)), ',') AS line FROM embeddings""")
def matrix_text_round_trip(spark, d):
    """The whole matrix of embeddings as text."""
    folder = scratch_path(spark, "files")
    files.write_matrix(table(spark, d, "embeddings").select("embedding"), "embedding", folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


@query("report_file", f"""WITH {WORDS_SQL} SELECT 'No. ' || row_number() OVER (ORDER BY word) || ': ' || word || ' ' || n AS line FROM counts""")
def report_file(spark, d):
    folder = scratch_path(spark, "files")
    ranked = global_rank(tx.word_counts(table(spark, d, "documents"), "text"), "word", name="no")
    files.write_report(ranked.select("no", F.format_string("No. %d: %s %d", "no", "word", "n").alias("line")), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


@query("vector_file", "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings")
def vector_file(spark, d):
    folder = scratch_path(spark, "files")
    files.save_vectors(table(spark, d, "embeddings"), folder)
    return files.load_vectors(spark, folder).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


@query("incremental_save", "SELECT o_orderkey, o_totalprice FROM orders")
def incremental_save(spark, d):
    """Orders saved batch by batch; the second batch is written twice and counts once."""
    folder = scratch_path(spark, "files")
    write = files.append_batch(folder)
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    write(orders.filter("o_orderkey % 2 = 0"), 0)
    for _ in range(2):
        write(orders.filter("o_orderkey % 2 <> 0"), 1)
    return spark.read.schema(orders.schema).option("recursiveFileLookup", "true").parquet(folder)


@query("dot_file_round_trip", f"WITH {TALK_SQL} SELECT CAST(conv_id AS VARCHAR) AS graph, 'n' || src AS src, 'n' || dst AS dst FROM flow")
def dot_file_round_trip(spark, d):
    folder = scratch_path(spark, "files")
    nodes = table(spark, d, "conversations").select(
        F.col("conv_id").alias("graph"), F.col("turn").alias("node"), F.lit("STATEMENT").alias("type"), F.col("role").alias("code"))
    gs.write_dot(nodes, talk_edges(spark, d), folder)
    return gs.parse_edges(gs.read_dot(spark, folder), "statement").select("graph", "src", "dst")


@query("dot_clusters_round_trip", """SELECT CAST(conv_id AS VARCHAR) AS graph, CAST(turn AS VARCHAR) AS node, role AS type, text AS code,
    CASE WHEN turn = 0 THEN NULL WHEN role = 'user' THEN 'asked' ELSE 'answered' END AS cluster FROM conversations""")
def dot_clusters_round_trip(spark, d):
    """Turns in nested clusters, their whole texts as codes, written with their loops' edges turned round and read back."""
    talk = table(spark, d, "conversations")
    place = F.when(F.col("turn") > 0, F.when(F.col("role") == "user", "asked").otherwise("answered"))
    nodes = talk.select(F.col("conv_id").alias("graph"), F.col("turn").alias("node"), F.col("role").alias("type"), F.col("text").alias("code"), place.alias("cluster"))
    graphs = talk.select(F.col("conv_id").alias("graph")).distinct()
    tree = F.array(*[F.struct(F.lit(c).alias("cluster"), F.lit(p).cast("string").alias("parent")) for c, p in (("talk", None), ("asked", "talk"), ("answered", "talk"))])
    parts = graphs.select("graph", F.explode(tree).alias("x")).select("graph", "x.*")
    entries = talk.filter("turn = 0").select(F.col("conv_id").alias("graph"), F.col("turn").alias("node"))
    folder = scratch_path(spark, "files")
    clusters.write_clusters(clusters.clustered_statements(nodes, talk_edges(spark, d, True), parts, entries), folder)
    return clusters.parse_nodes(clusters.read_statements(spark, folder))


PATHS_SQL = f"""WITH RECURSIVE {TALK_SQL}, ends AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1),
  named AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'START' ELSE 'STATEMENT' END AS type, role || ' ' || turn AS label FROM conversations),
  p AS (SELECT conv_id, turn, [turn] AS nodes, [label] AS labels, [type] AS types FROM named WHERE turn = 0 UNION ALL
    SELECT p.conv_id, f.dst, list_append(nodes, f.dst), list_append(labels, n.label), list_append(types, n.type)
    FROM p JOIN flow f ON f.conv_id = p.conv_id AND f.src = p.turn JOIN named n ON n.conv_id = f.conv_id AND n.turn = f.dst),
  done AS (SELECT p.*, row_number() OVER (PARTITION BY p.conv_id ORDER BY nodes) AS path_id, count(*) OVER (PARTITION BY p.conv_id) AS total
    FROM p JOIN ends e ON e.conv_id = p.conv_id AND p.turn = e.last)"""


def _documents(spark, d):
    talk = table(spark, d, "conversations")
    starts = talk.filter("turn = 0").select(F.col("conv_id").alias("graph"), F.col("turn").alias("node"))
    ends = talk.groupBy(F.col("conv_id").alias("graph")).agg(F.max("turn").alias("node"))
    kind = F.when(F.col("turn") == 0, "START").otherwise("STATEMENT")
    nodes = talk.select(
        F.col("conv_id").alias("graph"), F.col("turn").alias("node"), kind.alias("type"), F.concat_ws(" ", "role", "turn").alias("label"))
    return gs.document_paths(gr.simple_paths(talk_edges(spark, d), starts, ends), nodes), starts, ends


@query("path_documents", PATHS_SQL + " SELECT CAST(conv_id AS VARCHAR) AS name, path_id, array_to_string(labels, ' --> ') AS path FROM done")
def path_documents(spark, d):
    folder = scratch_path(spark, "files")
    paths, _, _ = _documents(spark, d)
    gs.write_documents(gs.path_documents(paths), folder)
    return gs.read_paths(spark, folder)


@query("path_documents_detailed", PATHS_SQL + """ SELECT conv_id AS source_file, total AS total_paths, ['0'] AS start_nodes, [CAST(turn AS VARCHAR)] AS return_nodes, path_id,
  CAST(len(nodes) AS INTEGER) AS length, list_transform(nodes, lambda x: CAST(x AS VARCHAR)) AS node_ids, types, labels FROM done""")
def path_documents_detailed(spark, d):
    docs = gs.detailed_documents(*_documents(spark, d))
    flat = docs.select("source_file", "total_paths", "start_nodes", "return_nodes", F.explode("paths").alias("p"))
    return flat.select(
        "source_file", "total_paths", "start_nodes", "return_nodes", "p.path_id", "p.length", F.col("p.nodes.node_id").alias("node_ids"),
        F.col("p.nodes.type").alias("types"), F.col("p.nodes.label").alias("labels"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
