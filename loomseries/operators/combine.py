"""Aggregates with a combine function of the caller."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import fields_of


def fold_aggregate(
    df: DataFrame, key: str, value: str, combine: Callable[[float, float], float], identity: float, out: str
) -> DataFrame:
    """``combine`` over the values of each key; it must be associative and commutative.

    Every task first folds its own rows to one value per key, so what is
    shuffled and brought together for a key is one row per task. Rows are
    sorted by key for that, and one key's value is held at a time. NULL values
    don't count, as in SQL; a key without other values gets NULL.
    """
    pairs = df.select(key, F.col(value).cast("double").alias(out))
    schema = T.StructType([*fields_of(df, [key]), T.StructField(out, T.DoubleType())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now, total = False, None, None
        for batch in batches:
            names, folded = [], []
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not open_ or name != now:
                    if open_:
                        names.append(now)
                        folded.append(total)
                    open_, now, total = True, name, None
                if x is not None:
                    total = float(combine(identity if total is None else total, x))
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field(0).type), pa.array(folded, pa.float64())], [key, out])
            kind = batch.schema.field(0).type
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([total], pa.float64())], [key, out])

    partial = pairs.sortWithinPartitions(key).mapInArrow(runs, schema)
    return partial.repartition(key).sortWithinPartitions(key).mapInArrow(runs, schema)


def call_rows(
    df: DataFrame, argument: str, call: Callable[[str], str | None], out: str, attempts: int = 3, first_wait: float = 1.0
) -> DataFrame:
    """Add the text ``call`` returns for each row; a failing call is repeated, waiting 1 s, 2 s, ..., then NULL."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def once(value):
        for attempt in range(attempts):
            try:
                return call(value)
            except Exception:
                if attempt + 1 < attempts:
                    time.sleep(first_wait * 2**attempt)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [once(v) for v in pdf[argument]]})

    return df.mapInPandas(run, schema)
