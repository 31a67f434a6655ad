"""Importance resampling towards a target: hashed n-grams, gains per bucket, Gumbel draws.

The text work is done by Arrow kernels: ``ascii_lower``,
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode`` turn a batch
into indices of its distinct words. Indices beside those shifted by one are the
two-word features; each distinct pair gets its CRC once, from the CRCs of its
words. Buckets' counts are summed over all documents and over the target. Their
gains are then taken by index and summed by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved

BUCKETS = 10_000
SCALE = 1000  # gains and draws are whole thousandths
SEED = 7
SHARE = 25  # per cent of the documents that may be drawn
MIN_WORDS = 20
PIECE_BYTES = 1 << 21  # texts handled at once; longer ones are cut between words

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


# -- checksums of joined words ------------------------------------------

def _by_bytes(columns: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by what it makes of each bit, as four tables for a number's bytes."""
    values = np.arange(256, dtype=np.uint32)
    tables = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            tables[byte] ^= np.where(values >> bit & 1, columns[8 * byte + bit], 0).astype(np.uint32)
    return tables


def _mapped(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


_STEP = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32) ^ np.uint32(zlib.crc32(b"\0"))
_STEPS: list[np.ndarray] = []  # tables that put 1, 2, 4, ... zero bytes behind


def _behind(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What checksums ``x`` contribute with ``n`` more bytes behind them."""
    bit, x = 0, x.copy()
    while len(n) and (n >> bit).any():
        if bit == len(_STEPS):
            powers = np.uint32(1) << np.arange(32, dtype=np.uint32)
            once = _mapped(_STEPS[-1], _mapped(_STEPS[-1], powers)) if _STEPS else _STEP[powers & 255] ^ powers >> 8
            _STEPS.append(_by_bytes(once))
        at = np.flatnonzero(n >> bit & 1)
        x[at] = _mapped(_STEPS[bit], x[at])
        bit += 1
    return x


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two texts in a row from their own and the second one's size."""
    return _behind(first, size) ^ second


# -- features -----------------------------------------------------------

@dataclass
class Features:
    """Buckets of a batch's one-word and two-word features, with the place where each text's end."""

    singles: np.ndarray
    single_ends: np.ndarray
    pairs: np.ndarray
    pair_ends: np.ndarray

    def counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.singles, minlength=buckets) + np.bincount(self.pairs, minlength=buckets)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """The sum of each text's gains."""
        total = 0
        for at, ends in ((self.singles, self.single_ends), (self.pairs, self.pair_ends)):
            upto = np.concatenate([[0], np.cumsum(gains[at])])
            total = total + np.diff(upto[ends], prepend=0)
        return total


def features(texts: pa.Array, buckets: int = BUCKETS) -> Features:
    parts = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), pattern=SEPARATORS)
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    kept = pc.greater(pc.binary_length(flat), 0)  # a separator at an end leaves an empty part
    coded = flat.filter(kept).dictionary_encode()
    owner = owner.filter(kept).to_numpy().astype(np.int64)
    at = coded.indices.to_numpy().astype(np.int64)
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    crc = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
    spaced = np.fromiter((zlib.crc32(b" ", c) for c in crc.tolist()), np.uint32, len(names))
    size = np.fromiter(map(len, names), np.int64, len(names))

    beside = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = pa.array(at[beside] * len(names) + at[beside + 1]).dictionary_encode()
    first, second = np.divmod(pairs.dictionary.to_numpy(), max(1, len(names)))
    pair_crc = joined_crc(spaced[first], crc[second], size[second])
    rows = np.arange(len(texts))
    return Features(
        (crc % buckets).astype(np.int64)[at], np.searchsorted(owner, rows, side="right"),
        (pair_crc % buckets).astype(np.int64)[pairs.indices.to_numpy()], np.searchsorted(owner[beside], rows, side="right"))


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array, bool]]:
    """First row, texts, and whether this is a later part of a long text, which starts with the last word of the part before."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(column).to_numpy())
    row = 0
    while row < len(column):
        before = ends[row - 1] if row else 0
        to = max(row + 1, int(np.searchsorted(ends, before + size, side="right")))
        if to > row + 1 or ends[row] - before <= 2 * size:
            yield row, column.slice(row, to - row), False
        else:
            data = np.frombuffer(column[row].as_py().encode(), np.uint8)
            blanks, at = np.flatnonzero(_SEPARATOR[data]), 0
            while at < len(data):
                place = np.searchsorted(blanks, at + size)
                end = int(blanks[place]) if place < len(blanks) else len(data)
                yield row, pa.array([data[at:end].tobytes().decode()], pa.large_string()), at > 0
                if end == len(data):
                    break
                words = np.flatnonzero(~_SEPARATOR[data[at:end]])
                if len(words):  # back to the start of the last word
                    last = at + words[-1]
                    cut = np.searchsorted(blanks, last)
                    start = int(blanks[cut - 1]) + 1 if cut else 0
                    if start > at:
                        at = start
                        continue
                at = end
        row = to


def _slim(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(f"`{text}`").alias("text"))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts, later in pieces(batch.column(0)):
                found = features(texts, buckets)
                total += found.counts(buckets)
                if later and len(found.singles):  # this word was counted with the part before
                    total[found.singles[0]] -= 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = _slim(docs, text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of target share over source share, each bucket counted once more."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(SCALE * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)],
        np.int64)


def weights(docs: DataFrame, gains: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean of its features' gains) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for batch in batches:
            n_words, n_pairs, sums = (np.zeros(len(batch), np.int64) for _ in range(3))
            for row, texts, later in pieces(batch.column(1)):
                found, at = features(texts, len(gains)), slice(row, row + len(texts))
                repeated = later and len(found.singles) > 0
                n_words[at] += np.diff(found.single_ends, prepend=0) - repeated
                n_pairs[at] += np.diff(found.pair_ends, prepend=0)
                sums[at] += found.sums(gains) - (gains[found.singles[0]] if repeated else 0)
            n = n_words + n_pairs
            columns = [batch.column(0), *map(pa.array, (n_words, n, np.where(n > 0, sums // np.maximum(n, 1), 0)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    slim = docs.selectExpr("cast(doc_id as bigint) as doc_id", f"`{text}` as text")
    return slim.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_ranks(df: DataFrame, share: int) -> DataFrame:
    """Add rank: 1, 2, 3, ... by falling score, then doc_id, to ``share`` per cent of the rows, NULL to the others.

    Rows are sorted over all partitions and written, which fixes their places;
    each then counts on from the partitions before its own, of which a table
    with one row each is broadcast.
    """
    n = df.count()
    parts = max(1, min(n // 200_000, 10_000) + 1)
    ordered = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    fixed = saved(df.repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    rank = (F.col("_skip") + place + 1).cast("long")
    ranked = fixed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return ranked.withColumn("rank", F.when(rank <= share * n // 100, rank)).drop("_at", "_part", "_skip")


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, text: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score and rank for every row of ``docs``; ``target`` holds the texts to resemble.

    A word is a run of ASCII letters (A-Z as a-z), digits and all characters
    beyond ASCII; features are words and pairs of neighbours. The score is the
    weight and a Gumbel draw by doc_id. Of the documents with ``min_words``
    words, ``share`` per cent (rounded down) with the highest scores are drawn:
    rank 1, 2, 3, ..., ties to the smaller doc_id; others have no rank. A NULL
    text has no features and weight 0. A NULL doc_id draws with an empty id and
    comes last of a tie; repeated rows have equal scores and neighbouring ranks. Empty tables
    count 0 everywhere. Columns of other names are not looked at. Only the
    ``buckets`` counts of either table come to the driver; every task sends at
    most as many.
    """
    gains = bucket_gains(bucket_counts(docs, buckets, text), bucket_counts(target, buckets, text))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    score = (F.col("weight") + F.floor(-SCALE * F.log(-F.log(uniform)))).cast("long")
    scored = saved(weights(docs, gains, text).withColumn("score", score).withColumn("_row", F.monotonically_increasing_id()))
    enough = F.col("n_words") >= min_words
    ranked = with_ranks(scored.where(enough), share).unionByName(scored.where(~enough), allowMissingColumns=True)
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT i AS n, 0 AS k, i AS v FROM range(256) t(i)
  UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
texts AS (
  SELECT true AS own, doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents
  UNION ALL SELECT false, NULL, row_number() OVER (), {_WORDS} FROM benchmark),
found AS (
  SELECT own, doc_id, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM texts),
codes AS (
  SELECT f, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM found))),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM codes, steps),
placed AS (SELECT own, doc_id, r, bucket FROM found JOIN hashed USING (f)),
counts AS (
  SELECT bucket, count(*) FILTER (own)::DOUBLE AS s, count(*) FILTER (NOT own)::DOUBLE AS t FROM placed GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gained AS (SELECT bucket, floor({SCALE} * ln((t + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS}))))::BIGINT AS gain FROM counts, totals),
weighed AS (
  SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gained USING (bucket) WHERE own GROUP BY r),
drawn AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-{SCALE} * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (r) WHERE own),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM drawn WHERE n_words >= {MIN_WORDS})
SELECT d.doc_id, n_features, weight, score, CASE WHEN rank <= {SHARE} * n // 100 THEN rank END AS rank
FROM drawn d LEFT JOIN ranked USING (doc_id)
"""
