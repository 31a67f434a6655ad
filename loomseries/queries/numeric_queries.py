"""Vectors, statistics, ranges, number theory and scheduling on the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as nm
from ..functions import text as tx
from ..operators import combine, intervals, ordered_tree, schedule, som, stats, vector, vector_index
from ..plans.series import Series
from ..session import saved, scratch_path
from .tables import TICK_GRAIN, rounded, table, ticks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


# -- vectors
UNIT_SQL = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM v WHERE list_inner_product(e, e) > 0)"""


@query("vector_top_k", f"""WITH {UNIT_SQL}, s AS (SELECT a.vec_id, list_sum(list_transform(list_zip(a.u, q.u), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
  FROM u a, (SELECT u FROM u WHERE vec_id = 0) q)
  SELECT vec_id, round(d2, 6) + 0.0 AS l2_sq, round(1 - d2 / 2, 6) + 0.0 AS cosine FROM s ORDER BY d2, vec_id LIMIT 10""")
def vector_top_k(spark, d):
    df = table(spark, d, "embeddings")
    target = df.filter("vec_id = 0").select("embedding").first()
    return rounded(vector.nearest(df, "embedding", "vec_id", target[0] if target else [], 10), ["l2_sq", "cosine"])


@query("vector_index_search")
def vector_index_search(spark, d):
    """Five nearest of every 50th vector by an inverted-list index.

    These vectors hardly cluster: three quarters of the lists are searched to find at least nine of ten neighbours.
    """
    df = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = vector_index.build(df, "vec_id", "embedding")
    found = vector_index.search(index, df.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5, max(1, len(index.centres) * 3 // 4))
    return rounded(found.drop("compared"), ["cosine"])


NEAREST_SQL = f"""{UNIT_SQL}, ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_inner_product(q.u, c.u), 9) AS cosine FROM u q, u c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id)::INTEGER AS rank FROM ranked)"""


@query("vector_index_saved", f"""WITH {NEAREST_SQL} SELECT query_id, rank, id, round(cosine, 6) + 0.0 AS cosine, label
  FROM best JOIN (SELECT vec_id AS id, label FROM v) USING (id) WHERE rank <= 5""")
def vector_index_saved(spark, d):
    """Five nearest of every 50th vector, all lists searched, in an index that was written and loaded."""
    df = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    path = scratch_path(spark, "indexes")
    vector_index.save(vector_index.build(df, "vec_id", "embedding", keep=["label"]), path)
    index = vector_index.load(spark, path)
    found = vector_index.search(index, df.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5, len(index.centres), keep=["label"])
    return rounded(found.drop("compared"), ["cosine"])


def _graph_search(df):
    """Graphs over lists of some thousand vectors, of which all are searched while they are few."""
    lists = max(1, min(int(df.count() ** 0.5), df.count() // vector_index.BLOCK))
    index = vector_index.with_graphs(vector_index.build(df, "vec_id", "embedding", lists=lists))
    return vector_index.search(index, df.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5, 64)


@query("vector_graph_search")
def vector_graph_search(spark, d):
    """Five nearest of every 50th vector as found by walking graphs, with the number of rows each was compared with."""
    return rounded(_graph_search(table(spark, d, "embeddings").select("vec_id", "embedding")), ["cosine"])


@query("vector_graph_recall", f"""WITH {NEAREST_SQL} SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS nine_of_ten_found
  FROM best WHERE rank <= 5""")
def vector_graph_recall(spark, d):
    """Whether the walks find nine of ten of the five nearest; a row as near as the fifth counts."""
    df = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = vector_index.build(df, "vec_id", "embedding")
    exact = vector_index.search(index, df.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5, len(index.centres))
    last = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least"))
    hits = _graph_search(df).join(last, "query_id").filter("cosine >= least").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    both = last.join(hits, "query_id", "left").agg(
        F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("wanted"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    return both.select("queries", "wanted", (F.col("hits") * 10 >= F.col("wanted") * 9).alias("nine_of_ten_found"))


@query("vector_norms", """SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm FROM (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) > 0)""")
def vector_norms(spark, d):
    wide = F.transform("embedding", lambda x: x.cast("double"))
    df = table(spark, d, "embeddings").filter(vector.has_vector("embedding"))
    return rounded(df.select("vec_id", F.sqrt(vector.dot(wide, wide)).alias("norm")), ["norm"])


@query("unit_vectors", f"""WITH {UNIT_SQL} SELECT vec_id, list_transform(u, lambda x: round(x, 6) + 0.0) AS unit FROM u""")
def unit_vectors(spark, d):
    df = vector.unit(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding").filter("embedding IS NOT NULL")
    return df.select("vec_id", F.transform("embedding", lambda x: F.round(x, 6) + F.lit(0.0)).alias("unit"))


@query("matrix_arg_min", """WITH m AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS col, unnest(embedding) AS value FROM embeddings)
  SELECT value, vec_id, col FROM m ORDER BY value, vec_id, col LIMIT 1""")
def matrix_arg_min(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "value"))
    return stats.arg_min_first(df, "value", "vec_id", "col")


# -- statistics
# Means of short decimals often end just at a decimal rounding place, where two engines may differ;
# so the results are compared in single precision, whose places they don't meet.
@query("running_stats", """SELECT sym, event_id, CAST(avg(x) OVER w AS FLOAT)::DOUBLE AS mean,
  CAST(coalesce(var_samp(x) OVER w, 0) AS FLOAT)::DOUBLE AS var_sample, CAST(var_pop(x) OVER w AS FLOAT)::DOUBLE AS var_population
  FROM (SELECT event_type AS sym, event_id, ts, value AS x FROM events)
  WINDOW w AS (PARTITION BY sym ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_stats(spark, d):
    s = Series.of(ticks(spark, d).drop("user_id"), ["sym"], ["ts", "event_id"], TICK_GRAIN)
    return rounded_stats(stats.running_stats(s, "real").df)


def rounded_stats(df):
    names = ["mean", "var_sample", "var_population"]
    return df.select("sym", "event_id", *[F.col(n).cast("float").cast("double").alias(n) for n in names])


def _points(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"),
        (F.col("p_retailprice") / 100).alias("y"), (F.col("p_partkey") % 5).cast("int").alias("group"))


@query("kmeans_step", """WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y, CAST(p_partkey % 5 AS INTEGER) AS g FROM part),
  c AS (SELECT g, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY g)
  SELECT id, arg_min(c.g, ((x - cx) * (x - cx) + (y - cy) * (y - cy), c.g)) AS "group" FROM p, c GROUP BY id""")
def kmeans_step(spark, d):
    return stats.kmeans_step(_points(spark, d)).select("id", "group")


@query("kmeans", """WITH RECURSIVE p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y, CAST(p_partkey % 5 AS INTEGER) AS g FROM part),
  m(i, g, x, y, n) AS (SELECT 0, g, avg(x), avg(y), count(*) FROM p GROUP BY g
    UNION ALL SELECT i + 1, g, avg(x), avg(y), count(*) FROM (
      SELECT i, id, p.x, p.y, arg_min(m.g, ((p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y), m.g)) AS g FROM p, m WHERE i < 150 GROUP BY i, id, p.x, p.y) GROUP BY i, g)
  SELECT g AS "group", round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, n AS size FROM m WHERE i = 150""")
def kmeans(spark, d):
    return rounded(stats.centroids_of(stats.kmeans(_points(spark, d))), ["x", "y"])


@query("som_epoch", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) > 0),
  u AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS unit, e AS w FROM (SELECT * FROM v ORDER BY vec_id LIMIT 16)),
  near AS (SELECT vec_id, e, arg_min(unit, (list_sum(list_transform(list_zip(e, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), unit)) AS unit FROM v, u GROUP BY vec_id, e),
  hits AS (SELECT unit, count(*) AS n FROM near GROUP BY unit),
  sums AS (SELECT unit, d, sum(x) AS s FROM (SELECT unit, unnest(range(1, len(e) + 1)) AS d, unnest(e) AS x FROM near) GROUP BY ALL),
  h AS (SELECT a.unit AS unit, b.unit AS from_unit, exp(-((a.unit // 4 - b.unit // 4) ** 2 + (a.unit % 4 - b.unit % 4) ** 2) / 2.0) AS h FROM u a, u b),
  total AS (SELECT h.unit, sum(h * n) AS t FROM h JOIN hits ON hits.unit = from_unit GROUP BY h.unit),
  moved AS (SELECT h.unit, d, round(sum(h * s) / t, 6) + 0.0 AS w FROM h JOIN sums ON sums.unit = from_unit JOIN total ON total.unit = h.unit GROUP BY h.unit, d, t)
  SELECT moved.unit, coalesce(max(n), 0) AS rows, list(w ORDER BY d) AS weights FROM moved LEFT JOIN hits ON hits.unit = moved.unit GROUP BY moved.unit""")
def som_epoch(spark, d):
    """One batch epoch of a 4 x 4 map over the embeddings, which starts from the first 16 of them."""
    df = table(spark, d, "embeddings").filter(vector.has_vector("embedding"))
    start = np.array([r[0] for r in df.orderBy("vec_id").limit(16).select("embedding").collect()], float)
    units, n, _ = som.epoch(df, "embedding", start, som.neighbourhood(4, 4, 1.0))
    rows = [(i, int(n[i]), [float(x) for x in units[i]]) for i in range(len(units))]
    out = spark.createDataFrame(rows, "unit long, rows long, weights array<double>")
    return out.select("unit", "rows", F.transform("weights", lambda x: F.round(x, 6) + F.lit(0.0)).alias("weights"))


@query("range_aggregate", """WITH q AS (SELECT o_orderkey AS id, o_custkey * 7 AS a, o_custkey * 7 + o_orderkey % 1000 AS b FROM orders)
  SELECT id, min(value) AS min_value, max(value) AS max_value, round(coalesce(sum(value), 0), 2) AS sum_value FROM q LEFT JOIN events ON event_id BETWEEN a AND b GROUP BY id""")
def range_aggregate(spark, d):
    ask = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 7).alias("a"), (F.col("o_custkey") * 7 + F.col("o_orderkey") % 1000).alias("b"))
    out = stats.range_aggregate(table(spark, d, "events"), "event_id", "value", ask, "id", "a", "b")
    return rounded(out, ["sum_value"], 2)


# Affine maps modulo a prime, composed in the order of event_id: a combine function that does not commute.
PRIME = 10_007
MAP_SQL = f"m AS (SELECT event_id, [event_id % 97 + 1, CAST(floor(value) AS BIGINT) % {PRIME}] AS v FROM events)"
RANGE_SQL = f"""q AS (SELECT o_orderkey AS id, o_custkey * 7 AS a, o_custkey * 7 + o_orderkey % 1000 AS b FROM orders),
  l AS (SELECT id, list(v ORDER BY event_id) FILTER (v IS NOT NULL) AS vs FROM q LEFT JOIN m ON event_id BETWEEN a AND b GROUP BY id),
  r AS (SELECT id, list_reduce(list_prepend([1, 0]::BIGINT[], coalesce(vs, [])),
    lambda x, y: [x[1] * y[1] % {PRIME}, (y[1] * x[2] + y[2]) % {PRIME}]) AS v FROM l) SELECT id, v[1] AS factor, v[2] AS term FROM r"""


def _then(x, y):
    """The map x, then y, of a vector (factor, term) a row."""
    return np.stack([x[:, 0] * y[:, 0] % PRIME, (y[:, 0] * x[:, 1] + y[:, 1]) % PRIME], axis=1)


def _map_tree(spark, d):
    maps = table(spark, d, "events").select(
        "event_id", F.array((F.col("event_id") % 97 + 1).cast("long"), F.floor("value").cast("long") % PRIME).alias("v"))
    return ordered_tree.build(maps, "event_id", "v", scratch_path(spark, "trees"), _then, (1, 0))


def _composed(tree, spark, d):
    ask = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 7).alias("a"), (F.col("o_custkey") * 7 + F.col("o_orderkey") % 1000).alias("b"))
    return tree.ranges(ask, "id", "a", "b").select("id", F.col("value")[0].alias("factor"), F.col("value")[1].alias("term"))


@query("range_combine", f"WITH {MAP_SQL}, {RANGE_SQL}")
def range_combine(spark, d):
    return _composed(_map_tree(spark, d), spark, d)


@query("tree_update", f"""WITH o AS (SELECT event_id, [event_id % 97 + 1, CAST(floor(value) AS BIGINT) % {PRIME}] AS v FROM events),
  m AS (SELECT event_id, CASE WHEN event_type = 'error' THEN [2, event_id % {PRIME}] ELSE v END AS v FROM o JOIN events USING (event_id)), {RANGE_SQL}""")
def tree_update(spark, d):
    """The same after the maps of all errors were replaced in the stored tree."""
    errors = table(spark, d, "events").filter("event_type = 'error'")
    changes = errors.select("event_id", F.array(F.lit(2).cast("long"), (F.col("event_id") % PRIME).cast("long")).alias("v"))
    return _composed(_map_tree(spark, d).update(changes, "event_id", "v"), spark, d)


@query("custom_combine", """SELECT event_type AS sym, CAST(max(event_id) AS DOUBLE) AS top FROM events GROUP BY 1""")
def custom_combine(spark, d):
    """A combine function of the caller, here the larger of two."""
    df = table(spark, d, "events").select(F.col("event_type").alias("sym"), F.col("event_id").cast("double").alias("x"))
    return combine.fold_aggregate(df, "sym", "x", max, float("-inf"), "top")


@query("point_update", """SELECT p_partkey, coalesce(s_acctbal, p_retailprice) AS p_retailprice FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def point_update(spark, d):
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_acctbal").alias("p_retailprice"))
    return stats.point_update(table(spark, d, "part").select("p_partkey", "p_retailprice"), new, "p_partkey", "p_retailprice")


# -- intervals
@query("asof_last", """SELECT p.event_id, p.value, e.value AS last_value, e.event_id AS last_id FROM
  (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN
  (SELECT * FROM events WHERE event_type = 'click') e ON p.user_id = e.user_id AND p.ts >= e.ts""")
def asof_last(spark, d):
    events = table(spark, d, "events")
    left = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    right = events.filter("event_type = 'click'").select(
        "user_id", "ts", F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    right_id = right.withColumn("event_id", F.col("last_id"))
    out = intervals.asof_last(left, right_id, ["user_id"], "ts", "event_id", ["last_value", "last_id"], 3_600_000_000)
    return out.select("event_id", "value", "last_value", "last_id")


LINES_SQL = """l AS (SELECT doc_id, k, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
  SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
nodes AS (SELECT doc_id, 0 AS node_id, CAST(0 AS BIGINT) AS start, CAST(length(text) AS BIGINT) AS stop FROM documents UNION ALL
  SELECT doc_id, k + 1, CAST(start AS BIGINT), CAST(start + length(line) AS BIGINT) FROM l),
pieces AS (SELECT doc_id, k, piece, coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
  SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS piece FROM (
    SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS x FROM documents))),
points AS (SELECT doc_id, k AS point_id, CAST(start AS BIGINT) AS pos FROM pieces WHERE piece <> '')"""


@query("narrowest_interval", f"""WITH {LINES_SQL} SELECT p.doc_id, CAST(point_id AS INTEGER) AS point_id, CAST(arg_min(node_id, (stop - start, -start, node_id)) AS INTEGER) AS node_id
  FROM points p JOIN nodes n ON n.doc_id = p.doc_id AND start <= pos AND pos < stop GROUP BY ALL""")
def narrowest_interval(spark, d):
    """Every word start of a text in its line, or in the whole text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    # Rows of one doc_id, or of none, are one text whose pieces are mixed by their numbers.
    same = saved(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id")))
    match = docs["doc_id"].eqNullSafe(same["_id"])
    mixed = not same.isEmpty()
    alone = docs.join(same, match, "left_anti") if mixed else docs

    def pieces(cuts):
        """(doc_id, k, start, n): parts of the text between cuts, with a running offset."""
        parts = tx.pieces(alone, "doc_id", "text", cuts)
        if not mixed:
            return parts
        others = tx.pieces(docs.join(same, match, "left_semi"), "doc_id", "text", cuts)
        before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        return parts.unionByName(others.withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0))))

    lines = pieces("\n").select("doc_id", (F.col("k") + 1).alias("node_id"), "start", (F.col("start") + F.col("n")).alias("stop"))
    whole = docs.select("doc_id", F.lit(0).alias("node_id"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("stop"))
    points = pieces(" \n").filter("n > 0").select("doc_id", F.col("k").alias("point_id"), F.col("start").alias("pos"))
    out = intervals.narrowest_interval(points, whole.unionByName(lines), "doc_id")
    return out.select("doc_id", "point_id", "node_id")


# -- number theory, codes
@query("divisor_square_sums", """SELECT p_partkey, CAST((SELECT sum(d * d) FROM range(1, p_partkey + 1) t(d) WHERE p_partkey % d = 0) AS BIGINT) AS s
  FROM part WHERE p_partkey > 0""")
def divisor_square_sums(spark, d):
    df = table(spark, d, "part").filter("p_partkey > 0")
    return df.select("p_partkey", nm.divisor_square_sum(F.col("p_partkey")).cast("long").alias("s"))


@query("abundant_sums", """WITH dv AS (SELECT n, sum(d) AS s FROM (SELECT d, unnest(range(2 * d, 28124, d)) AS n FROM range(1, 14062) t(d)) GROUP BY 1),
  ab AS (SELECT n FROM dv WHERE s > n),
  sums AS (SELECT DISTINCT a.n + b.n AS n FROM ab a JOIN ab b ON b.n >= a.n AND b.n <= 28123 - a.n)
  SELECT p_partkey, p_partkey > 28123 OR p_partkey IN (SELECT n FROM sums) AS is_sum FROM part""")
def abundant_sums(spark, d):
    return nm.sum_of_abundant(table(spark, d, "part").select("p_partkey"), "p_partkey")


@query("prime_factors", """WITH RECURSIVE f AS (SELECT p_partkey AS n, p_partkey AS rest, CAST(2 AS BIGINT) AS d, CAST([] AS BIGINT[]) AS found FROM part WHERE p_partkey >= 2
  UNION ALL SELECT n, CASE WHEN rest % d = 0 THEN rest // d ELSE rest END, CASE WHEN rest % d = 0 THEN d ELSE d + 1 END,
  CASE WHEN rest % d = 0 THEN list_append(found, d) ELSE found END FROM f WHERE rest > 1)
  SELECT n AS p_partkey, found AS factors FROM f WHERE rest = 1""")
def prime_factors(spark, d):
    df = table(spark, d, "part").filter("p_partkey >= 2")
    return df.select("p_partkey", nm.prime_factors(F.col("p_partkey")).alias("factors"))


@query("base_digits", "SELECT o_orderkey, lower(hex(o_orderkey)) AS digits FROM orders")
def base_digits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", nm.to_base(F.col("o_orderkey"), "0123456789abcdef").alias("digits"))


ALAW_SQL = """s AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) % 65536 - 32768 AS pcm FROM events),
  a AS (SELECT *, CASE WHEN pcm < 0 THEN -pcm - 1 ELSE pcm END AS m FROM s),
  b AS (SELECT *, CASE WHEN m >= 16384 THEN 7 WHEN m >= 8192 THEN 6 WHEN m >= 4096 THEN 5 WHEN m >= 2048 THEN 4 WHEN m >= 1024 THEN 3
    WHEN m >= 512 THEN 2 WHEN m >= 256 THEN 1 ELSE 0 END AS g FROM a),
  e AS (SELECT event_id, pcm, CAST(xor(CASE WHEN pcm < 0 THEN 128 ELSE 0 END + g * 16 + ((m >> CASE WHEN g = 0 THEN 4 ELSE g + 3 END) & 15), 213) AS INTEGER) AS code FROM b)"""


@query("alaw_codes", f"WITH {ALAW_SQL} SELECT event_id, code FROM e")
def alaw_codes(spark, d):
    pcm = (F.floor(F.col("value") * 100).cast("long") % 65536 - 32768).cast("int")
    return table(spark, d, "events").select("event_id", nm.alaw_encode(pcm).alias("code"))


@query("alaw_round_trip", f"""WITH {ALAW_SQL}, x AS (SELECT *, xor(code, 213) AS p FROM e),
  y AS (SELECT *, (p >> 4) & 7 AS seg, (p & 15) * 16 + 8 AS low FROM x),
  z AS (SELECT *, (low + CASE WHEN seg > 0 THEN 256 ELSE 0 END) << greatest(seg - 1, 0) AS size FROM y)
  SELECT event_id, CAST(pcm AS INTEGER) AS pcm, CAST(CASE WHEN p & 128 <> 0 THEN -size ELSE size END AS INTEGER) AS back FROM z""")
def alaw_round_trip(spark, d):
    pcm = (F.floor(F.col("value") * 100).cast("long") % 65536 - 32768).cast("int")
    df = table(spark, d, "events").select("event_id", pcm.alias("pcm"))
    return df.withColumn("back", nm.alaw_decode(nm.alaw_encode(F.col("pcm"))))


@query("text_crc32", """WITH RECURSIVE bits AS (SELECT i AS n, 0 AS k, i AS v FROM range(256) t(i) UNION ALL
    SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
  steps AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
  raw AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
  codes AS (SELECT doc_id, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM raw)
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM codes, steps""")
def text_crc32(spark, d):
    return table(spark, d, "documents").select("doc_id", nm.crc32(F.col("text")).alias("crc"))


@query("text_blake2b")
def text_blake2b(spark, d):
    return table(spark, d, "documents").select("doc_id", nm.blake2b(F.col("text")).alias("digest"))


# -- scheduling
def _jobs(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("id"), F.floor(seconds).cast("long").alias("at"),
        F.ceil(F.col("value") * 50).cast("long").alias("bt"), (F.col("event_id") % 7).alias("priority"))


JOBS_SQL = """jobs AS (SELECT user_id, event_id AS id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS at, CAST(ceil(value * 50) AS BIGINT) AS bt,
    event_id % 7 AS priority FROM events),
  served AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS now, CAST([] AS BIGINT[]) AS done, CAST(-1 AS BIGINT) AS id FROM jobs
    UNION ALL SELECT user_id, greatest(now, j[2]) + j[3], list_append(done, j[1]), j[1] FROM (
      SELECT s.user_id, s.now, s.done, arg_min([k.id, k.at, k.bt], CASE WHEN k.at <= s.now THEN [0, 0, k.priority, k.at, k.id]
        ELSE [1, k.at, k.priority, k.at, k.id] END) AS j
      FROM served s JOIN jobs k ON k.user_id = s.user_id AND NOT list_contains(s.done, k.id) GROUP BY ALL)),
  timed AS (SELECT j.*, CAST(now AS DOUBLE) AS ct, CAST(now - j.at AS DOUBLE) AS tat, CAST(now - j.at - j.bt AS DOUBLE) AS wt
    FROM served s JOIN jobs j ON j.id = s.id)"""


@query("priority_schedule", f"WITH RECURSIVE {JOBS_SQL} SELECT * FROM timed")
def priority_schedule(spark, d):
    return schedule.priority_schedule(_jobs(spark, d), ["user_id"], 3600)


@query("schedule_averages", f"""WITH RECURSIVE {JOBS_SQL} SELECT user_id, round(avg(ct), 4) AS avg_ct, round(avg(tat), 4) AS avg_tat,
  round(avg(wt), 4) AS avg_wt FROM timed GROUP BY user_id""")
def schedule_averages(spark, d):
    out = schedule.schedule_averages(schedule.priority_schedule(_jobs(spark, d), ["user_id"], 3600), ["user_id"])
    return rounded(out, ["avg_ct", "avg_tat", "avg_wt"], 4)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
