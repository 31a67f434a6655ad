"""Mixing sources to target weights by Poisson replication, with built-in functions only.

A source's repetition rate is its target share of the output's bytes over its
own bytes. Every document of the source gets a count from the Poisson
distribution with that mean, by inversion: the smallest k whose cumulated
probability reaches u, a uniform number from a hash of the seed and the doc_id.
It is repeated that often, and all copies are sorted by another hash. That hash
is uniform, so the ranges of the sort's partitions are known beforehand: no
sample of the rows is drawn, and every text is shuffled once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseries.session import saved

SEED = "mix-1"
POWER = 0.5  # without given weights a source's weight is its bytes to this power
EPOCHS = 1.0  # output bytes over input bytes
PART = 500.0  # larger means are sums of independent parts, since exp(-mean) has to stay above 0
NUMBERS = 1 << 20  # distributions of up to so many numbers in all (8 MB) are broadcast
SMALL, LARGE = 4 << 20, 64 << 20  # bytes of a partition of the result: fewer only above the session's number, more never
ROW = 64  # bytes of a row besides its text


def _hash(digits: int, *parts: Column) -> Column:
    """A whole number of that many hexadecimal digits from the parts' text."""
    text = F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _uniform(*parts: Column) -> Column:
    return (_hash(13, *parts).cast("double") + 0.5) / F.lit(float(1 << 52))


def _cumulated(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, until what is left doesn't count."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 25).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["c"])


def _rated(docs: DataFrame, weights: dict[str, float] | None, epochs: float) -> tuple[DataFrame, float]:
    """``rates`` and the expected bytes of the result."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(POWER))
    elif not weights:
        weight = F.lit(0.0)
    else:
        given = F.create_map(*[F.lit(x) for s, w in sorted(weights.items()) for x in (s, float(w))])
        weight = F.coalesce(F.element_at(given, F.col("source")), F.lit(0.0))
    sizes = saved(sizes.withColumn("weight", weight))
    all_ = sizes.agg(F.sum("bytes").alias("bytes"), F.sum("weight").alias("weight")).first()
    scale = (all_.bytes or 0) * float(epochs) / all_.weight if all_.weight else 0.0
    rate = F.when(F.col("bytes") > 0, F.col("weight") * F.lit(scale) / F.col("bytes"))
    if weights is None:
        rate = F.coalesce(rate, F.lit(float(epochs)))
    rate = F.coalesce(rate, F.when(F.col("weight") > 0, F.lit(float(epochs))).otherwise(F.lit(0.0)))
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    rated = sizes.withColumn("rate", rate)
    expected = rated.agg(F.sum(F.col("rate") * (F.col("bytes") + ROW * F.col("rows")))).first()[0]
    found = (
        rated.select("source", "rate").withColumn("parts", parts)
        .withColumn("cumulated", _cumulated(F.col("rate") / F.col("parts")))
    )
    return found, expected or 0.0


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """source, rate, parts and the cumulated distribution of a part, for every source of ``docs``.

    ``weights`` are target weights by source (a source without one gets none of
    the output). A source without bytes has the rate ``epochs``, or 0 without weight.
    """
    return _rated(docs, weights, epochs)[0]


def _partitions(expected: float, usual: int) -> int:
    """The session's number of partitions, fewer for a small result and more for a large one."""
    return max(1, math.ceil(expected / LARGE), min(usual, math.ceil(expected / SMALL)))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, source, ...) with copy (from 1) and shuffle_key, sorted by shuffle_key.

    A source may be NULL and is then a source like any other. NULL texts count 0
    bytes. Repeated rows and rows without a doc_id have the counts of their
    doc_id; each row is repeated. Ties of shuffle_key are sorted by doc_id and
    copy. Columns of ``docs`` that are called copy or shuffle_key are replaced;
    any other name is free. An empty table gives an empty result. The rows of a
    large source are not brought together: the sources are counted first, and
    their rates are broadcast up to ``NUMBERS`` numbers. Beyond that it is a
    join by source, which Spark splits where it is skewed.
    """
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    found, expected = _rated(docs.select("source", "text"), weights, epochs)
    numbers = found.agg(F.sum(F.size("cumulated"))).first()[0] or 0
    few = F.broadcast(found) if numbers <= NUMBERS else found
    met = packed.join(few, packed["doc.source"].eqNullSafe(few["source"]))
    doc_id = F.col("doc.doc_id")
    counts = F.transform(
        F.sequence(F.lit(1), F.col("parts")), lambda j: F.size(F.filter("cumulated", lambda c: c < _uniform(doc_id, F.lit("n"), j))))
    copies = (
        met.select("doc", F.aggregate(counts, F.lit(0), lambda a, b: a + b).alias("n")).where("n > 0")
        .select("doc", F.explode(F.expr("sequence(1, n)")).alias("copy"))
        .select("doc", "copy", _hash(15, doc_id, F.lit("s"), F.col("copy")).alias("shuffle_key"))
    )
    n = _partitions(expected, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Keys have 60 bits; partition i of n takes the i-th n-th of their range.
    part = F.shiftright(F.shiftright("shuffle_key", 30) * F.lit(n), 30).cast("int")
    dealt = copies.repartitionById(n, part).sortWithinPartitions("shuffle_key", doc_id, "copy")
    return dealt.select("doc.*", "copy", "shuffle_key")


ORACLE = f"""
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0)) AS bytes FROM documents GROUP BY source),
weighted AS (SELECT *, pow(bytes::DOUBLE, {POWER}) AS weight FROM sizes),
rated AS (
  SELECT source, CASE WHEN bytes > 0 THEN weight * ((SELECT sum(bytes) FROM weighted)::DOUBLE * {EPOCHS} / (SELECT sum(weight) FROM weighted)) / bytes
    ELSE {EPOCHS} END AS rate FROM weighted),
parted AS (SELECT *, greatest(ceil(rate / {PART}), 1)::BIGINT AS parts FROM rated),
terms AS (
  SELECT source, rate, parts, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) AS p
  FROM (SELECT *, unnest(range(0, ceil(rate / parts + 10 * sqrt(rate / parts) + 25)::BIGINT + 1)) AS k FROM parted)),
cumulated AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (
  SELECT r, doc_id, text, lang, source, n_chars, j,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':n:' || j), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)} AS u
  FROM (SELECT row_number() OVER () AS r, d.*, unnest(range(1, parts + 1)) AS j
        FROM documents d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source)),
lists AS (SELECT source, list(c) AS cs FROM cumulated GROUP BY source),
counted AS (
  SELECT r, sum(len(list_filter(cs, lambda c: c < u))) AS n
  FROM drawn d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source GROUP BY r),
copied AS (
  SELECT d.*, unnest(range(1, n::BIGINT + 1)) AS copy
  FROM (SELECT DISTINCT r, doc_id, text, lang, source, n_chars FROM drawn) d JOIN counted USING (r))
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':s:' || copy), 1, 15))::BIGINT AS shuffle_key
FROM copied
"""
