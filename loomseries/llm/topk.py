"""Exact top-k by inner product, with a uniform threshold in three phases.

A vector's components are dealt into ``LISTS`` lists of neighbouring
components; a score is the sum of one partial score from each list. Vectors are
filed once, under the nearest of at most ``CENTRES`` of them, in blocks; a
query is sent to blocks, and only there do the two meet.

1. Each query goes to one block of each of the ``FIRST`` nearest centres, which gather
   the best entries of each of their score lists. The k-th best whole score of these
   is its cutoff: no result scores less.
2. The cutoff goes with the query to every block that can reach it: the partial scores
   of a block are bounded by those of its centre and the farthest of its rows. With m
   lists, a pair whose partial scores are all below cutoff / m scores less than the
   cutoff, so the entries from there on are sufficient; pairs whose seen scores and
   bounds can't reach it are left out.
3. For the remaining pairs the missing lists are looked up, and each block's k best
   whole scores are merged.

Vectors are shuffled by id, and by block in each pass; a query is copied only to the
blocks it is sent to, and at most k rows go back from each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved

LISTS = 2
VECTOR_BLOCK = 4096
QUERY_BLOCK = 512
CENTRES = 256  # vectors that others are filed under, at most: these come to the driver
FIRST = 2
SPANS = 500_000  # blocks whose bounds, three numbers each, are broadcast; beyond it they are joined by centre
TASKS = 20_000  # partitions that blocks are dealt to, at most
_SENT = 8192  # rows sent out at once
_SLACK = 1e-9  # of a bound, far beyond the rounding of doubles
_ENTRIES = "query_id long, vec_id long, score long"
_MEETING = "block long, query boolean, id long, v array<bigint>, cutoff long"
_LEAST = -(1 << 63)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of whole numbers, cut at ``width`` or filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(lengths, default=0) if width is None else width
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    fits = place < width
    out[row[fits], place[fits]] = column.flatten().to_numpy()[fits]
    return out


def _cuts(width: int, lists: int) -> list[int]:
    return [width * i // lists for i in range(lists + 1)]


class _Block:
    """The vectors of a block; of equal ones the k + 1 smallest ids, as one may be the query itself."""

    def __init__(self, column: pa.Array, ids: np.ndarray, k: int):
        v = _matrix(column)
        order = np.lexsort((ids, *v.T[::-1]))
        v, ids = v[order], ids[order]
        start = np.concatenate([[True], (v[1:] != v[:-1]).any(axis=1)])
        place = np.arange(len(v)) - np.maximum.accumulate(np.where(start, np.arange(len(v)), 0))
        self.v, self.ids = v[place <= k], ids[place <= k]
        self.largest = float(np.abs(self.v.astype(float)).max(initial=0))

    def partial(self, column: pa.Array, lists: int) -> tuple[list[np.ndarray], float]:
        """Partial scores of queries with all vectors, by list, in a kind in which they are exact; a number beyond all scores."""
        width = self.v.shape[1]
        q = _matrix(column, width)
        beyond = width * self.largest * float(np.abs(q.astype(float)).max(initial=0)) + 1
        kind = np.float32 if 2 * lists * beyond < 2**24 else np.float64 if 2 * lists * beyond < 2**53 else object
        q, v, cuts = q.astype(kind), self.v.astype(kind), _cuts(width, lists)
        return [q[:, a:b] @ v[:, a:b].T if b > a else np.zeros((len(q), len(v)), kind) for a, b in zip(cuts, cuts[1:], strict=False)], beyond


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, query_ids: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each row: higher scores first, then smaller ids."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], ids[i])), dtype=np.int64)
        scores = np.array([min(max(int(s), _LEAST), -_LEAST - 1) for s in scores], dtype=np.int64)
    else:
        scores = scores.astype(np.int64)
        order = np.lexsort((ids, -scores, rows))
    rows = rows[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    order, rows = order[place < k], rows[place < k]
    return pa.record_batch({"query_id": query_ids[rows], "vec_id": ids[order], "score": scores[order]})


def _gather(block: _Block, queries: pa.RecordBatch, k: int, lists: int) -> pa.RecordBatch:
    """Phase 1 in a block."""
    query_ids = queries.column("id").to_numpy()
    (parts, _), ids = block.partial(queries.column("v"), lists), block.ids
    seen = np.zeros(parts[0].shape, bool)
    some = min(k + 1, len(ids))
    for p in parts:
        top = np.argpartition(-p, some - 1, axis=1)[:, :some] if p.dtype != object else np.argsort(-p, axis=1)[:, :some]
        np.put_along_axis(seen, top, True, axis=1)
    rows, at = np.nonzero(seen & (query_ids[:, None] != ids[None, :]))
    return _best(rows, ids[at], sum(p[rows, at] for p in parts), query_ids, k)


def _resolve(block: _Block, queries: pa.RecordBatch, k: int, lists: int) -> pa.RecordBatch:
    """Phases 2 and 3 in a block."""
    query_ids = queries.column("id").to_numpy()
    (parts, beyond), ids = block.partial(queries.column("v"), lists), block.ids
    kind = parts[0].dtype
    if kind == object:
        cutoff = np.array([-(1 << 80) if c is None else c for c in queries.column("cutoff").to_pylist()], object)
    else:  # a cutoff beyond all scores of the block keeps all or none, however far beyond
        cutoff = queries.column("cutoff").cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
        cutoff = np.clip(np.where(np.isnan(cutoff), -beyond, cutoff), -beyond, beyond).astype(kind)
    seen = [lists * p >= cutoff[:, None] for p in parts]
    rows, at = np.nonzero(np.logical_or.reduce(seen) & (query_ids[:, None] != ids[None, :]))
    level = cutoff[rows]
    # A list in which a pair was not seen gives less than cutoff / m.
    found, unseen = np.zeros(len(rows), kind), np.zeros(len(rows), np.int64)
    for p, s in zip(parts, seen, strict=True):
        hit = s[rows, at].astype(bool)
        found[hit] += p[rows[hit], at[hit]]
        unseen += ~hit
    able = np.array(lists * found + unseen * level >= lists * level, bool)
    rows, at, level = rows[able], at[able], level[able]
    total = sum(p[rows, at] for p in parts)
    good = np.array(total >= level, bool)
    return _best(rows[good], ids[at[good]], total[good], query_ids, k)


def _meet(phase: Callable, k: int, lists: int) -> Callable:
    """Rows come block by block, vectors ahead of queries: a block is held, queries pass by in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vectors, block = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            asks = batch.column("query").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                if a == b:
                    continue
                if blocks[a] != at:
                    at, vectors, block = blocks[a], [], None
                if not asks[a]:
                    vectors.append(batch.slice(a, b - a))
                    continue
                if block is None:
                    whole = pa.Table.from_batches(vectors).combine_chunks().to_batches()[0]
                    vectors, block = [], _Block(whole.column("v"), whole.column("id").to_numpy(), k)
                for s in range(a, b, QUERY_BLOCK):
                    yield phase(block, batch.slice(s, min(QUERY_BLOCK, b - s)), k, lists)

    return run


class _Map:
    """Centres, and for each of them how many blocks it has and how far its rows are from it, by list of components."""

    def __init__(self, centres: np.ndarray, lists: int):
        self.centres, self.lists = centres.astype(float), lists
        self.starts = self.blocks = self.radii = None

    def split(self, column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows and centres as doubles, by list; components beyond those of any centre belong to the last list."""
        rows = _matrix(column).astype(float)
        wide = max(rows.shape[1], self.centres.shape[1])
        filled = [np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (rows, self.centres)]
        cuts = [*_cuts(self.centres.shape[1], self.lists)[:-1], wide]
        return tuple([m[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)] for m in filled)

    def file(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest centre of each vector, and its distance by list."""
        for batch in batches:
            rows, centres = self.split(batch.column("v"))
            gaps = sum((c * c).sum(axis=1) - 2 * (r @ c.T) for r, c in zip(rows, centres, strict=True))
            near = np.argmin(gaps, axis=1)
            far = np.stack([np.linalg.norm(r - c[near], axis=1) for r, c in zip(rows, centres, strict=True)], axis=1)
            far = pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), self.lists).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns, pa.array(near.astype(np.int32)), far], ["id", "v", "centre", "far"])

    def first(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries for a block of each of the nearest centres that have any."""
        for batch in batches:
            rows, centres = self.split(batch.column("v"))
            score = np.where(self.blocks > 0, sum(r @ c.T for r, c in zip(rows, centres, strict=True)), -np.inf)
            some = min(FIRST, int((self.blocks > 0).sum()))
            near = np.argsort(-score, axis=1, kind="stable")[:, :some].ravel()
            query = np.repeat(np.arange(batch.num_rows), some)
            ids = batch.column("id").to_numpy()[query]
            yield self.sent(batch, query, self.starts[near] + ids % self.blocks[near])

    def sent(self, batch: pa.RecordBatch, query: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        rows = batch.take(pa.array(query))
        return pa.record_batch({
            "block": block.astype(np.int64), "query": np.ones(len(query), bool), "id": rows.column("id"), "v": rows.column("v"),
            "cutoff": pa.nulls(len(query), pa.int64())})

    def reach(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries for each centre whose farthest rows may reach the cutoff, with what bounds the scores of its blocks."""
        some = max(1, _SENT // len(self.centres))
        for batch in (b.slice(i, some) for b in batches for i in range(0, b.num_rows, some)):
            rows, centres = self.split(batch.column("v"))
            sizes = np.stack([np.linalg.norm(r, axis=1) for r in rows], axis=1) * (1 + _SLACK)
            lengths = np.stack([np.linalg.norm(c, axis=1) for c in centres], axis=1)
            base = sum(r @ c.T for r, c in zip(rows, centres, strict=True)) + _SLACK * (sizes @ lengths.T) + 1
            cutoff = batch.column("cutoff").cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
            open_ = np.isnan(cutoff)[:, None] | (base + sizes @ (self.radii * (1 + _SLACK)).T >= cutoff[:, None])
            query, centre = np.nonzero(open_ & (self.blocks > 0))
            norms = pa.FixedSizeListArray.from_arrays(pa.array(sizes[query].ravel()), self.lists).cast(pa.list_(pa.float64()))
            taken = batch.take(pa.array(query))
            yield pa.record_batch(
                [*taken.columns, pa.array(centre.astype(np.int32)), pa.array(base[query, centre]), norms],
                [*batch.schema.names, "centre", "base", "norms"])


def search(vectors: DataFrame, queries: DataFrame, k: int, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best vectors for each query.

    Both tables have a whole number ``id`` and ``v``, an array of whole numbers;
    shorter arrays count as filled up with zeros. Candidates are the rows with
    another id than the query's. Ties go to the smaller id; with fewer than k
    candidates all are returned. Rows with a NULL id or array take no part; of
    rows with the same id the one with the largest array counts. Empty tables
    give an empty result. A score beyond 64 bits is returned as the nearest long.
    """
    spark = vectors.sparkSession

    def distinct(df):
        return df.where("id is not null and v is not null").groupBy(F.col("id").cast("long").alias("id")).agg(
            F.max(F.col("v").cast("array<long>")).alias("v"))

    usable = vectors.where("id is not null and v is not null")
    wanted = min(CENTRES, -(-usable.count() // VECTOR_BLOCK))
    if not wanted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    drawn = usable.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<long>").alias("v"))
    drawn = drawn.orderBy(F.xxhash64("id"), "id", "v").limit(wanted).toArrow()["v"].combine_chunks()
    map_ = _Map(_matrix(drawn), lists)

    filed = saved(distinct(vectors).mapInArrow(map_.file, "id long, v array<bigint>, centre int, far array<double>"))
    farthest = F.array(*[F.max(F.col("far")[i]) for i in range(lists)]).alias("radii")
    found = {r.centre: r for r in filed.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), farthest).collect()}  # a row a centre
    map_.blocks = np.array([-(-found[i].n // VECTOR_BLOCK) if i in found else 0 for i in range(wanted)])
    map_.starts = np.cumsum(map_.blocks) - map_.blocks
    map_.radii = np.array([found[i].radii if i in found else [0.0] * lists for i in range(wanted)])

    numbers = spark.createDataFrame([(i, int(map_.starts[i]), int(map_.blocks[i])) for i in found], "centre int, start long, blocks long")
    placed = filed.join(F.broadcast(numbers), "centre").withColumn("block", F.col("start") + F.pmod(F.xxhash64("id"), "blocks"))
    spans = placed.groupBy("centre", "block").agg(farthest)
    held = placed.select("block", F.lit(False).alias("query"), "id", "v", F.lit(None).cast("long").alias("cutoff"))
    tasks = min(TASKS, int(map_.blocks.sum()))

    def met(sent, phase):
        dealt = held.unionByName(sent).repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int"))
        return dealt.sortWithinPartitions("block", "query").mapInArrow(_meet(phase, k, lists), _ENTRIES)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked = saved(distinct(queries))
    gathered = ranked(met(asked.mapInArrow(map_.first, _MEETING), _gather))
    # The least long may stand for less, so it is no cutoff.
    cutoffs = gathered.groupBy(F.col("query_id").alias("id")).agg(
        F.when((F.count(F.lit(1)) == k) & (F.min("score") > _LEAST), F.min("score")).alias("cutoff"))
    known = saved(asked.join(cutoffs, "id", "left").select("id", "v", "cutoff"))
    reached = known.mapInArrow(map_.reach, "id long, v array<bigint>, cutoff long, centre int, base double, norms array<double>")
    bound = F.aggregate(F.zip_with("norms", "radii", lambda n, r: n * r * (1 + _SLACK)), F.col("base"), lambda a, x: a + x)
    # Queries are many times their table's size here, so Spark must not take them for the small side.
    spans = F.broadcast(spans) if map_.blocks.sum() <= SPANS else spans.hint("merge")
    sent = reached.join(spans, "centre").where(F.col("cutoff").isNull() | (bound >= F.col("cutoff").cast("double")))
    sent = sent.select("block", F.lit(True).alias("query"), "id", "v", "cutoff")
    return ranked(met(sent, _resolve)).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """(id, v) with v = floor(256 * x) of each component, as double; vectors with a NULL or non-finite component are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.where(F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))
