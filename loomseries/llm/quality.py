"""Quality by logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Tokens are runs of letters and digits (any byte above 127 counts as a letter)
and runs of other bytes that aren't blank, so signs glued to a word are tokens
of their own. Single tokens and pairs of neighbours are hashed into 2 ** 18
places; pairs of equal tokens all share one place. A document is the sparse vector of the square roots of its counts,
scaled to length 1; its score is the sigmoid of the dot product with the
weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words

BITS = 18
SAMPLE = 8000  # labelled rows that a model learns from, about
EPOCHS = 3
CUT = 0.3

# FTRL-proximal: learning rate, its offset, and the L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

_SIGN = np.ones(256, bool)
_SIGN[48:58] = _SIGN[65:91] = _SIGN[97:123] = _SIGN[128:] = False
_SIGN[words.BLANK] = False
_LETTER = ~_SIGN & ~words.BLANK

_AGAIN = np.uint64(0x5EED5EED5EED5EED)  # the hash of any token that follows itself

RESULT = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: str = "doc_id") -> Column:
    """Is the row kept from learning? A row without an id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def features(texts: words.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place and value of every feature of some texts, in the order of the texts."""
    s1, e1 = texts.runs(_LETTER[texts.data])
    s2, e2 = texts.runs(_SIGN[texts.data])
    starts, ends = np.concatenate([s1, s2]), np.concatenate([e1, e2])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    hashes, owner = texts.hashes(starts, ends), texts.owner(starts)
    pairs = np.flatnonzero(owner[:-1] == owner[1:])
    twos = words.grams(hashes, 2, pairs)
    twos[hashes[pairs] == hashes[pairs + 1]] = _AGAIN
    found = np.concatenate([hashes, twos]) >> np.uint64(64 - BITS)
    keys = np.concatenate([owner, owner[pairs]]).astype(np.uint64) << np.uint64(BITS) | found
    keys, counts = np.unique(keys, return_counts=True)
    owner = (keys >> np.uint64(BITS)).astype(np.int64)
    norm = np.bincount(owner, counts, minlength=len(texts))
    return owner, (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), np.sqrt(counts / norm[owner])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text, ...) -> (label, places, values)."""
    for batch in batches:
        for row, texts in words.texts_of(batch.column(1)):
            owner, place, value = features(texts)
            cuts = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i).slice(row, len(texts)) for i in (0, 2)),
                pa.ListArray.from_arrays(cuts, pa.array(place)), pa.ListArray.from_arrays(cuts, pa.array(value.astype(np.float32))),
            ], ["label", "turn", "places", "values"])


def _ftrl(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One online pass over rows (label, turn, places, values); the last place is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at=slice(None)):
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for batch in batches:
        for label, places, values in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            at = np.append(places.values.to_numpy(), 1 << BITS)
            x = np.append(values.values.to_numpy(), 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights()
    some = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(w[some])], ["place", "weight"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights (the last one is the bias) from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    About ``sample`` labelled rows are drawn by a hash of doc_id, never held-out
    ones; all of them if there are fewer. NULL labels don't count, several
    labels of a document are averaged, half or more counts as 1. The updates run
    in one task, in an order given by the hash; it holds one batch at a time.
    """
    known = (
        labels.where("quality is not null").where(~held_out()).groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    )
    part = min(1.0, sample / max(1, known.count()))
    turn = F.xxhash64(F.lit("quality"), F.col("doc_id"))
    drawn = known.where((turn / 2.0**64 + 0.5) <= part)
    # About ``sample`` rows of two numbers: small enough to broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("label", "text", turn.alias("turn"))
    vectors = rows.mapInArrow(_vectors, "label double, turn long, places array<int>, values array<float>")
    again = vectors.select("label", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"), "turn", "places", "values")
    ordered = again.repartition(1).sortWithinPartitions("epoch", "turn", F.size("places"))
    out = np.zeros((1 << BITS) + 1)
    # At most 2 ** 18 + 1 weights come to the driver.
    for w in ordered.select("label", "turn", "places", "values").mapInArrow(_ftrl, "place int, weight double").collect():
        out[w.place] = w.weight
    return out


def score(docs: DataFrame, weights: np.ndarray, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    NULL and empty texts have no features and get the score of the bias alone.
    Repeated rows get the same score; a row with a NULL doc_id is scored like
    any other and counts as held out. Texts of any length are read whole, other
    columns are not looked at, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = shared.value
            for row, texts in words.texts_of(batch.column(2)):
                owner, place, value = features(texts)
                sums = np.bincount(owner, w[place] * value, minlength=len(texts)) + w[-1]
                s = 1 / (1 + np.exp(-np.clip(sums, -500, 500)))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(i).slice(row, len(texts)) for i in (0, 1)),
                    pa.array(s), pa.array((s >= cut).astype(np.int32)),
                ], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, RESULT)
