"""Ordered recursions over a series, in parallel over chunks.

``scan`` runs v = max(floor, a * v + b) row by row, where ``a``, ``b`` and
``floor`` are columns. Such steps compose: any run of them is again
max(L, A * v + B). So each chunk is first reduced to one row of such numbers,
the value that enters each chunk follows from those rows, and a last pass
fills in the values. A recursion may take the new value of another one as its
input (an average of an average); together they are still one linear step, so
a whole cascade is one scan.

``state_scan`` is for steps that do not compose into a fixed form. It starts
each chunk from the state the chunk before ended in, and repeats only the
chunks whose entering state changed until none does.

The Python side sees the sorted rows of a partition as a stream of Arrow
batches and keeps only the current value, so neither a long chunk nor a
large number of short keys is a problem.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.numbering import matched
from ..plans.series import Series
from ..session import saved

NO_FLOOR = float("-inf")


@dataclass(frozen=True)
class Step:
    """v = max(floor, a * v + b + gain * feed), where ``feed`` names a recursion given before this one."""

    a: Column
    b: Column
    floor: Column | None = None
    feed: str | None = None
    gain: Column | None = None


def step_seed(seed_at: Column, seed: Column, a: Column | float, b: Column) -> Step:
    """Zero before the seed row, the seed at it, and the recursion after it."""
    started = F.col("rn") > seed_at
    at = F.col("rn") == seed_at
    a_col = F.when(started, a if isinstance(a, Column) else F.lit(float(a))).otherwise(F.lit(0.0))
    b_col = F.when(at, seed).when(started, b).otherwise(F.lit(0.0))
    return Step(a_col, b_col)


def step_after(seed_at: int, feed: str, weight: float) -> Step:
    """Exponential mean of the recursion ``feed``, seeded with its value on row ``seed_at``."""
    started = F.col("rn") > seed_at
    at = F.col("rn") == seed_at
    return Step(
        F.when(started, F.lit(1.0 - weight)).otherwise(F.lit(0.0)), F.lit(0.0), None, feed,
        F.when(at, F.lit(1.0)).when(started, F.lit(weight)).otherwise(F.lit(0.0)),
    )


def fields_of(df: DataFrame, names) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]


def doubles(names) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def by_group(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """Rows of a group together in one partition, in order."""
    return df.repartition(*group).sortWithinPartitions(*group, order)


def homed(df: DataFrame, key: list[str]) -> DataFrame:
    """Add ``_h``, a hash of the key that is never NULL: chunks are dealt out and joined by it."""
    return df.withColumn("_h", F.xxhash64(*key))


def by_home(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a chunk together in one partition, in order."""
    return df.repartition("_h", "chunk").sortWithinPartitions("_h", "chunk", *key, "rn")


def join_chunks(rows: DataFrame, per_chunk: DataFrame, key: list[str]) -> DataFrame:
    """Each row with the columns of its chunk; NULL keys have chunks too.

    The keys are compared after the join by hash, so that both sides keep the
    partitioning of ``by_home``.
    """
    other = per_chunk.withColumnsRenamed({n: f"_on_{n}" for n in (*key, "_h", "chunk")})
    same = (rows["_h"] == other["_on__h"]) & (rows["chunk"] == other["_on_chunk"])
    for n in key:
        a, b = rows[n], other[f"_on_{n}"]
        same = same & F.coalesce(a == b, a.isNull() & b.isNull())
    return rows.join(other, same, "left").drop("_on__h", "_on_chunk", *[f"_on_{n}" for n in key])


def floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as doubles, NULL as NaN."""
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float)


def chunk_starts(batch: pa.RecordBatch, chunk_rows: int) -> np.ndarray:
    """True on the first row of each chunk."""
    return (batch.column("rn").to_numpy(zero_copy_only=False) - 1) % chunk_rows == 0


def whole_chunks(batches: Iterator[pa.RecordBatch], chunk_rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that are not empty, with their chunk starts.

    A partition must begin with the start of a chunk. Should a plan ever cut a
    chunk over two tasks, this fails instead of starting from a wrong value.
    """
    begun = False
    for batch in batches:
        if batch.num_rows:
            first = chunk_starts(batch, chunk_rows)
            if not begun and not first[0]:
                raise RuntimeError("a chunk was split over two tasks")
            begun = True
            yield batch, first


def with_columns(batch: pa.RecordBatch, keep: list[str], **added: np.ndarray) -> pa.RecordBatch:
    """Kept columns as they are, and added doubles."""
    arrays = [batch.column(n) for n in keep] + [pa.array(v, type=pa.float64()) for v in added.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *added])


class _Blocks:
    """Rows dealt into blocks of neighbours, so that one step of numpy advances all blocks by a row.

    The blocks are first run without knowing what enters them, which gives the
    composed step of each; their ends are linked one after the other; then all
    are run again from what enters them.
    """

    def __init__(self, n: int):
        self.n = n
        self.length = max(1, int(np.sqrt(n / 2)))
        self.count = -(-n // self.length)

    def deal(self, x: np.ndarray, fill: float) -> np.ndarray:
        """One row per step, one column per block."""
        out = np.full(self.count * self.length, fill)
        out[: self.n] = x
        return np.ascontiguousarray(out.reshape(self.count, self.length).T)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x.T).reshape(-1)[: self.n]


def _follow(first, enter, a, b, lo, v):
    """Values of the recursion; where ``first``, ``enter`` takes the place of the value before."""
    if not len(b):
        return np.empty(0)
    with np.errstate(invalid="ignore", over="ignore"):
        # A first row does not depend on the row before it.
        b = np.where(first & (a != 0.0), a * enter + b, b)
        blocks = _Blocks(len(b))
        xs, ys = blocks.deal(np.where(first, 0.0, a), 1.0), blocks.deal(b, 0.0)
        floored = bool((lo != NO_FLOOR).any())
        zs = blocks.deal(lo, NO_FLOOR) if floored else None
        cuts = xs == 0.0
        any_cut = cuts.any(axis=1)
        big_a, big_b, big_l = np.ones(blocks.count), np.zeros(blocks.count), np.full(blocks.count, NO_FLOOR)
        for j, (x, y) in enumerate(zip(xs, ys)):
            if floored:
                low = np.where(big_l == NO_FLOOR, NO_FLOOR, x * big_l + y)
                big_l = np.where(cuts[j], zs[j], np.where(zs[j] > low, zs[j], low))
            if any_cut[j]:
                big_a, big_b = np.where(cuts[j], 0.0, x * big_a), np.where(cuts[j], y, x * big_b + y)
            else:
                big_a, big_b = x * big_a, x * big_b + y
        reset = cuts.any(axis=0).tolist()
        entering = np.empty(blocks.count)
        for k, (share, own, low) in enumerate(zip(big_a.tolist(), big_b.tolist(), big_l.tolist())):
            entering[k] = v
            # After a reset nothing is left of the old value, not even a NaN.
            v = own if reset[k] and share == 0.0 else share * v + own
            if v < low:
                v = low
        out, now = np.empty_like(xs), entering
        for j, (x, y) in enumerate(zip(xs, ys)):
            now = np.where(cuts[j], y, x * now + y) if any_cut[j] else x * now + y
            if floored:
                now = np.where(now < zs[j], zs[j], now)
            out[j] = now
        return blocks.rows(out)


def _compose(first, a, b, lo, run):
    """(A, B, L) of the rows since the last ``first``, at every row."""
    if not len(b):
        return np.empty((3, 0))
    with np.errstate(invalid="ignore", over="ignore"):
        blocks = _Blocks(len(b))
        xs, ys, zs = blocks.deal(a, 1.0), blocks.deal(b, 0.0), blocks.deal(lo, NO_FLOOR)
        news = blocks.deal(first.astype(float), 0.0) > 0
        cuts = xs == 0.0

        def step(j, big_a, big_b, big_l):
            x, y, z = xs[j], ys[j], zs[j]
            big_a, big_b = np.where(news[j], 1.0, big_a), np.where(news[j], 0.0, big_b)
            big_l = np.where(news[j], NO_FLOOR, big_l)
            low = np.where(big_l == NO_FLOOR, NO_FLOOR, x * big_l + y)
            big_l = np.where(cuts[j], z, np.where(z > low, z, low))
            return np.where(cuts[j], 0.0, x * big_a), np.where(cuts[j], y, x * big_b + y), big_l

        state = np.ones(blocks.count), np.zeros(blocks.count), np.full(blocks.count, NO_FLOOR)
        for j in range(blocks.length):
            state = step(j, *state)
        fresh = (news | cuts).any(axis=0).tolist()
        entering, (in_a, in_b, in_l) = np.empty((3, blocks.count)), run
        for k, (x, y, z) in enumerate(zip(*(part.tolist() for part in state))):
            entering[:, k] = in_a, in_b, in_l
            if fresh[k]:
                in_a, in_b, in_l = x, y, z
            else:
                in_l = z if in_l == NO_FLOOR else max(x * in_l + y, z)
                in_a, in_b = x * in_a, x * in_b + y
        out, state = np.empty((3, *xs.shape)), tuple(entering)
        for j in range(blocks.length):
            state = step(j, *state)
            out[:, j] = state
        return np.stack([blocks.rows(part) for part in out])


def _count_since(first, marked, before):
    """Marked rows since the last ``first``, at every row; ``before`` is the count that leads in."""
    total = np.cumsum(marked) + before
    base = np.where(first, total - marked, -1.0)
    return total - np.maximum(np.maximum.accumulate(base), 0.0)


def scan(s: Series, **steps: Step) -> Series:
    """Add one column per step; with a floor, ``a`` must not be negative."""
    whole = s.owned()
    base = replace(whole, df=homed(whole.df, list(whole.key)))
    names = list(steps)
    parts = {}
    for n, step in steps.items():
        for tag, value in (("a", step.a), ("b", step.b), ("l", step.floor), ("g", step.gain)):
            if value is not None:
                parts[f"_{tag}_{n}"] = value.cast("double")
    feed = {n: step.feed for n, step in steps.items()}
    floored = [n for n, step in steps.items() if step.floor is not None]
    # For each recursion the ones that reach it, itself first.
    reach = {}
    for n in names:
        reach[n] = [n, *(reach[feed[n]] if feed[n] else [])]
    group, key, chunk_rows = [*base.group, "_h"], list(base.key), base.chunk_rows
    kept = whole.df.columns
    # Both uses keep all columns and the join below adds no filter, so that they share one shuffle.
    rows = base.df.withColumns(parts)

    def run(batch, first, enter, value, only=names, inputs=True):
        """Values of the recursions ``only``; without ``inputs`` what is left of the entering values alone."""
        done = {}
        for n in only:
            b = floats(batch, f"_b_{n}") if inputs else np.zeros(batch.num_rows)
            if feed[n] in done:
                gain = floats(batch, f"_g_{n}")
                b = b + np.where(gain == 0.0, 0.0, gain * done[feed[n]])
            floor = floats(batch, f"_l_{n}") if n in floored and inputs else np.full(batch.num_rows, NO_FLOOR)
            done[n] = _follow(first, enter[n], floats(batch, f"_a_{n}"), b, floor, value[n])
        return done

    # Summary of a chunk: value from zero, part of each entering value, floor, and whether it was reset.
    totals = [f"_c_{n}" for n in names]
    shares = [f"_m_{n}_{j}" for n in names for j in reach[n]]
    extra = [f"_l_{n}" for n in floored] + [f"_r_{n}" for n in names]

    def reduce_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = dict.fromkeys(names, 0.0)
        value, left = dict(zero), {j: dict(zero) for j in names}
        limits = {n: (1.0, 0.0, NO_FLOOR) for n in floored}
        resets = dict(zero)
        held = None
        for batch, first in whole_chunks(batches, chunk_rows):
            starts = np.flatnonzero(first)
            none = {n: np.zeros(batch.num_rows) for n in names}
            done = run(batch, first, none, value)
            added = {f"_c_{n}": done[n] for n in names}
            value = {n: float(done[n][-1]) for n in names}
            for j in names:
                fed = [n for n in names if j in reach[n]]
                one = {**none, j: np.ones(batch.num_rows)}
                part = run(batch, first, one, left[j], fed, inputs=False)
                added.update({f"_m_{n}_{j}": part[n] for n in fed})
                left[j].update({n: float(part[n][-1]) for n in fed})
            for n in floored:
                added[f"_m_{n}_{n}"], added[f"_c_{n}"], added[f"_l_{n}"] = _compose(
                    first, floats(batch, f"_a_{n}"), floats(batch, f"_b_{n}"), floats(batch, f"_l_{n}"), limits[n])
                limits[n] = tuple(float(added[c][-1]) for c in (f"_m_{n}_{n}", f"_c_{n}", f"_l_{n}"))
            for n in names:
                added[f"_r_{n}"] = _count_since(first, floats(batch, f"_a_{n}") == 0.0, resets[n])
                resets[n] = float(added[f"_r_{n}"][-1])
            out = with_columns(batch, group, **{c: added[c] for c in (*totals, *shares, *extra)})
            if held is not None and first[0]:
                yield held
            ends = starts[starts > 0] - 1
            if len(ends):
                yield out.take(pa.array(ends))
            held = out.slice(out.num_rows - 1)
        if held is not None:
            yield held

    summary_type = T.StructType(fields_of(base.df, group) + doubles((*totals, *shares, *extra)))
    summary = by_home(rows, key).mapInArrow(reduce_chunks, summary_type)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = dict.fromkeys(names, 0.0)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            numbers = {c: floats(batch, c).tolist() for c in (*totals, *shares, *extra)}
            chunk = batch.column("chunk").to_pylist()
            added = {f"_v_{n}": np.zeros(batch.num_rows) for n in names}
            for i, at in enumerate(chunk):
                value = value if at else dict.fromkeys(names, 0.0)
                after = {}
                for n in names:
                    added[f"_v_{n}"][i] = value[n]
                    after[n] = numbers[f"_c_{n}"][i]
                    for j in reach[n]:
                        share = numbers[f"_m_{n}_{j}"][i]
                        # After a reset nothing is left of the old value, not even a NaN.
                        if share != 0.0 or not numbers[f"_r_{j}"][i]:
                            after[n] += share * value[j]
                    if n in floored and after[n] < numbers[f"_l_{n}"][i]:
                        after[n] = numbers[f"_l_{n}"][i]
                value = after
            yield with_columns(batch, group, **added)

    enter_type = T.StructType(fields_of(base.df, group) + doubles(f"_v_{n}" for n in names))
    entering = by_group(summary, key, "chunk").mapInArrow(enter, enter_type)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = dict.fromkeys(names, 0.0)
        for batch, first in whole_chunks(batches, chunk_rows):
            done = run(batch, first, {n: floats(batch, f"_v_{n}") for n in names}, value)
            value = {n: float(done[n][-1]) for n in names}
            yield with_columns(batch, kept, **done)

    fill_type = T.StructType(fields_of(base.df, kept) + doubles(names))
    joined = join_chunks(by_home(rows, key), entering, key).sortWithinPartitions("_h", "chunk", *key, "rn")
    filled = joined.mapInArrow(fill, fill_type)
    clean = {n: F.when(~F.isnan(n), F.col(n)) for n in names}
    return replace(whole, df=filled.withColumns(clean))


def state_scan(
    s: Series,
    step: Callable[[pa.RecordBatch, np.ndarray], tuple[dict[str, np.ndarray], np.ndarray]],
    width: int,
    outputs: list[str],
) -> Series:
    """Run ``step(rows, entering state) -> (output columns, leaving state)`` over each key.

    A state is ``width`` doubles; all-NaN means "nothing seen yet". The result
    is that of one pass in order, whatever the number of rounds.
    """
    base = s.owned()
    base = replace(base, df=saved(base.df))  # read once per round
    group, key, chunk_rows = base.group, list(base.key), base.chunk_rows
    kept = base.df.columns
    state = [f"_s{i}" for i in range(width)]

    def pieces(batches: Iterator[pa.RecordBatch]):
        """Runs of rows of one chunk with their outputs and the state after them."""
        now = None
        for batch, first in whole_chunks(batches, chunk_rows):
            starts = set(np.flatnonzero(first).tolist())
            cuts = sorted({0, batch.num_rows, *starts})
            for lo, hi in zip(cuts, cuts[1:]):
                rows = batch.slice(lo, hi - lo)
                if lo in starts:
                    now = np.array([floats(rows.slice(0, 1), c)[0] for c in state])
                values, now = step(rows, now)
                yield rows, values, now, lo in starts

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows, _, after, new in pieces(batches):
            if new and held is not None:
                yield held
            last = rows.slice(rows.num_rows - 1)
            held = with_columns(last, group, **{c: np.array([float(v)]) for c, v in zip(state, after)})
        if held is not None:
            yield held

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, values, _, _ in pieces(batches):
            yield with_columns(rows, kept, **{n: values[n] for n in outputs})

    state_type = T.StructType(fields_of(base.df, group) + doubles(state))

    def with_state(entering: DataFrame) -> DataFrame:
        joined = matched(base.df, entering, group)
        return by_group(joined, group, "rn")

    def run_chunks(entering: DataFrame) -> DataFrame:
        return with_state(entering).mapInArrow(leave, state_type)

    def shift(ends: DataFrame) -> DataFrame:
        over = Window.partitionBy(*key).orderBy("chunk")
        return ends.select(*group, *[F.coalesce(F.lag(c).over(over), F.lit(float("nan"))).alias(c) for c in state])

    cold = base.df.select(*group).distinct().select("*", *[F.lit(float("nan")).alias(c) for c in state])
    entering = saved(cold)
    ends = saved(run_chunks(entering))
    while True:
        following = shift(ends)
        old = entering.select(*group, *[F.col(c).alias(f"{c}_old") for c in state])
        same = F.lit(True)
        for c in state:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_old"))
        changed = saved(matched(following, old, group).filter(~same).select(*group, *state))
        if changed.isEmpty():
            break
        redone = run_chunks(changed)
        entering = saved(matched(entering, changed, group, "left_anti").unionByName(changed))
        ends = saved(matched(ends, changed.select(*group), group, "left_anti").unionByName(redone))

    fill_type = T.StructType(fields_of(base.df, kept) + doubles(outputs))
    filled = with_state(entering).mapInArrow(fill, fill_type)
    return replace(base, df=filled.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in outputs}))
