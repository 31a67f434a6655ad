"""Indicators over streams: state per key, updated by each micro-batch.

A processor keeps a few numbers per key (and for the moving average its last
values) in the state store. Spark sorts a micro-batch by key and order, on disk
where it is large, and hands a key's rows over in Arrow slices of at most
``spark.sql.execution.arrow.maxRecordsPerBatch`` rows. A task holds one slice and
one state at a time, however many rows a key has in a batch. From one batch to
the next a source has to be in order, as any source of a stream is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ascending(rows: pd.DataFrame, order: Sequence[str]) -> bool:
    """Whether the rows are in the order of the columns, NULL first."""
    tie = np.ones(max(len(rows) - 1, 0), bool)
    for name in order:
        column = rows[name]
        known = column.notna().to_numpy()
        a, b = column.to_numpy()[:-1], column.to_numpy()[1:]
        both = known[:-1] & known[1:]
        more, same = np.zeros(len(tie), bool), ~known[:-1] & ~known[1:]
        more[both], same[both] = a[both] > b[both], a[both] == b[both]
        more |= known[:-1] & ~known[1:]
        if (tie & more).any():
            return False
        tie &= same
    return True


class Folding(StatefulProcessor):
    """Base: a list of doubles as state, ``fold`` over the ordered slices of a batch."""

    def __init__(self, key: Sequence[str], order: Sequence[str], outputs: Sequence[str]):
        self.key, self.order, self.outputs = list(key), list(order), list(outputs)

    def start(self) -> list[float]:
        raise NotImplementedError

    def fold(self, rows: pd.DataFrame, state: list[float]) -> tuple[dict[str, np.ndarray], list[float]]:
        """Output columns, NaN where nothing is emitted, and the state after the rows."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("v", T.ArrayType(T.DoubleType()))])
        self.state = handle.getValueState("state", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = [float(v) for v in self.state.get()[0]] if self.state.exists() else self.start()
        last = None
        for piece in rows:
            if not len(piece):
                continue
            # A batch that isn't sorted, as when it was dealt to another number of partitions, gives an error, never wrong rows.
            ends = piece[self.order].iloc[:1] if last is None else pd.concat([last, piece[self.order].iloc[:1]])
            if not (ascending(ends, self.order) and ascending(piece, self.order)):
                raise ValueError(f"rows of key {key} are not in the order of {self.order}; start the stream with apply()")
            last = piece[self.order].iloc[-1:]
            values, state = self.fold(piece, state)
            out = piece[self.key + self.order].copy()
            for name in self.outputs:
                out[name] = values[name]
            yield out[~np.isnan(values[self.outputs[0]])]
        self.state.update(([float(v) for v in state],))

    def close(self) -> None:
        pass


class MovingAverage(Folding):
    """State: the last ``period`` values at most."""

    def __init__(self, period: int, key, order, column="real"):
        super().__init__(key, order, ["sma"])
        if period < 1:
            raise ValueError("period must be at least 1")
        self.period, self.column = period, column

    def start(self):
        return []

    def fold(self, rows, state):
        values = np.array([*state, *rows[self.column].astype(float)])
        held, p = len(state), self.period
        out = np.full(len(rows), np.nan)
        if len(values) >= p:
            means = np.lib.stride_tricks.sliding_window_view(values, p).mean(axis=1)
            from_row = max(p - 1, held)  # index in ``values`` of the first new row with a full frame
            out[from_row - held :] = means[from_row - p + 1 :]
        return {"sma": out}, values[-(p - 1):].tolist() if p > 1 else []


BLOCK = 128


def smoothed(values: np.ndarray, before: float, period: int) -> np.ndarray:
    """v += (value - v) / period for each value, from ``before`` on.

    Blocks of rows are multiplied with the powers of the weight; what is
    carried from block to block is a few steps.
    """
    keep = 1.0 - 1.0 / period
    away = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    weights = np.where(away >= 0, keep ** np.maximum(away, 0), 0.0) / period
    blocks = np.zeros((-(-len(values) // BLOCK), BLOCK))
    blocks.reshape(-1)[: len(values)] = values
    bad = np.flatnonzero(~np.isfinite(values))
    # Nothing that isn't finite may meet the zeros of the weights: rows before it keep their values.
    stop = int(bad[0]) if len(bad) else len(values)
    blocks.reshape(-1)[stop:] = 0.0
    inner = blocks @ weights.T
    enters = np.empty(len(blocks))
    full = keep**BLOCK
    for i, end in enumerate(inner[:, -1].tolist()):
        enters[i] = before
        before = before * full + end
    out = (inner + enters[:, None] * keep ** np.arange(1, BLOCK + 1)).reshape(-1)[: len(values)]
    out[stop:] = np.nan
    return out


class AverageTrueRange(Folding):
    """State: rows seen, sum or mean so far, last close."""

    def __init__(self, period: int, key, order):
        super().__init__(key, order, ["atr"])
        if period < 1:
            raise ValueError("period must be at least 1")
        self.period = period

    def start(self):
        return [0.0, 0.0, 0.0]

    def fold(self, rows, state):
        seen, value, last = int(state[0]), state[1], state[2]
        high, low, close = (rows[c].to_numpy(dtype=float) for c in ("high", "low", "close"))
        before = np.concatenate([[last], close[:-1]])
        width = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
        if not seen:
            width[0] = high[0] - low[0]
        out = np.full(len(rows), np.nan)
        first = min(max(self.period - seen, 0), len(rows))  # rows that are summed up
        if first:
            value = float(np.cumsum([value, *width[:first]])[-1])
            if seen + first == self.period:
                value /= self.period
                out[first - 1] = value
        if first < len(rows):
            out[first:] = smoothed(width[first:], value, self.period)
            value = float(out[-1])
        return {"atr": out}, [float(seen + len(rows)), value, float(close[-1])]


class RunningStats(Folding):
    """State: count, mean, sum of squared distances from the mean."""

    def __init__(self, key, order, column="real"):
        super().__init__(key, order, ["mean", "var_sample", "var_population"])
        self.column = column

    def start(self):
        return [0.0, 0.0, 0.0]

    def fold(self, rows, state):
        n, mean, spread = state
        x = rows[self.column].to_numpy(dtype=float)
        # Sums of distances from a value near the mean: the mean so far, or the first slice's.
        centre = mean if n else float(np.mean(x))
        count = n + np.arange(1, len(x) + 1)
        away = np.cumsum(x - centre)
        squares = spread + np.cumsum((x - centre) ** 2)
        spreads = np.maximum(squares - away * away / count, 0.0)
        means = centre + away / count
        out = (means, np.where(count > 1, spreads / np.maximum(count - 1, 1), 0.0), spreads / count)
        return dict(zip(self.outputs, out)), [float(count[-1]), float(means[-1]), float(spreads[-1])]


class Progress(Folding):
    """Rows seen less the rows an operator needs before it emits; negative while some are missing."""

    def __init__(self, start_rows: int, key, order):
        super().__init__(key, order, ["progress"])
        self.start_rows = start_rows

    def start(self):
        return [float(-self.start_rows)]

    def fold(self, rows, state):
        out = state[0] + np.arange(1, len(rows) + 1)
        return {"progress": out}, [float(out[-1])]


class StreamInfo(NamedTuple):
    """What a stream can be opened with: option names, outputs, and the rows it needs before it emits."""

    name: str
    options: tuple[str, ...]
    outputs: tuple[str, ...]
    start: Callable[..., int]
    make: Callable[..., Folding]


STREAMS = {
    info.name: info for info in (
        StreamInfo("sma", ("period",), ("sma",), lambda period: period - 1, MovingAverage),
        StreamInfo("atr", ("period",), ("atr",), lambda period: period - 1, AverageTrueRange),
        StreamInfo("stats", (), ("mean", "var_sample", "var_population"), lambda: 0, RunningStats),
    )
}


class OpenStream:
    """A stream opened by name: ``run`` gives its outputs, ``progress`` what its keys have seen beyond what it needs."""

    def __init__(self, name: str, options: Sequence[int], key: Sequence[str], order: Sequence[str]):
        if name not in STREAMS:
            raise KeyError(f"no stream named {name!r}")
        self.info, self.options = STREAMS[name], tuple(options)
        if len(self.options) != len(self.info.options):
            raise ValueError(f"{name} takes options {self.info.options}, got {list(options)}")
        self.key, self.order = list(key), list(order)

    def run(self, stream: DataFrame) -> DataFrame:
        return apply(stream, self.info.make(*self.options, self.key, self.order))

    def progress(self, stream: DataFrame) -> DataFrame:
        return apply(stream, Progress(self.info.start(*self.options), self.key, self.order))


def apply(stream: DataFrame, processor: Folding) -> DataFrame:
    """The streaming DataFrame with the processor's outputs.

    Rows are dealt to the state store's partitions by key and sorted there by
    key and order, which is the order in which the processor gets its slices.
    Spark refuses every sort of a stream, also one within a batch's partitions,
    which is meant here; so the session's check of streams is switched off. A
    stream keeps the number of partitions that it was first started with.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.unsupportedOperationCheck", "false")
    fields = [T.StructField(n, stream.schema[n].dataType) for n in (*processor.key, *processor.order)]
    schema = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in processor.outputs])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stream.repartition(n, *processor.key).sortWithinPartitions(*processor.key, *processor.order)
    return ordered.groupBy(*processor.key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def run_available(stream: DataFrame) -> DataFrame:
    """Run a stream over what its source holds now and return the rows it wrote."""
    spark: SparkSession = stream.sparkSession
    folder = scratch_path(spark, "streams")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start(f"{folder}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
