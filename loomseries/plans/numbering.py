"""Row numbers per key without sorting a whole key in one task.

A plain ``row_number().over(partitionBy(key).orderBy(ts))`` sends every row of
one key to one task. Here the order column is cut into buckets of a fixed
width (the grain). Rows are numbered inside ``(key, bucket)`` and shifted by
the number of rows in earlier buckets, which comes from a table with one row
per ``(key, bucket)``. The only window over a whole key is over that table.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import saved

HOUR = 3_600_000_000
DAY = 24 * HOUR


def time_then_id(ts: str, ident: str) -> Column:
    """One number that orders rows by time and then id.

    Unlike a struct it can be updated in place, so min_by / max_by over it stay
    hash aggregates with partial results on the map side.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(17,0)")
    return (micros * F.lit(Decimal(10**19)) + F.col(ident).cast("decimal(19,0)")).cast("decimal(38,0)")


def bucket_of(df: DataFrame, order: str, grain: int) -> Column:
    """Bucket number: whole grains in the microseconds of a timestamp, or in a whole number itself."""
    micros = isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType))
    value = f"unix_micros(cast(`{order}` as timestamp))" if micros else f"cast(`{order}` as bigint)"
    return F.expr(f"{value} div {int(grain)}")


def matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, where NULL equals NULL."""
    other = right.withColumnsRenamed({n: f"_on_{n}" for n in on})
    same = reduce(and_, [left[n].eqNullSafe(other[f"_on_{n}"]) for n in on])
    return left.join(other, same, how).drop(*[f"_on_{n}" for n in on])


def number_rows(
    df: DataFrame, key: Sequence[str], order: Sequence[str], grain: int, name: str = "rn"
) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... per ``key`` in ``order``; ``order`` must be unique per key.

    A NULL key is a key like any other, and NULL order values come first. The
    offset of a bucket travels as one row more, ahead of the bucket's own rows,
    so no join can lose any of them.
    """
    keys = list(key)
    placed = df.withColumn("_bucket", bucket_of(df, order[0], grain))
    sizes = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    both = placed.unionByName(offsets, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_skip").isNull(), *order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn(name, (F.row_number().over(inside) - 1 + F.max("_skip").over(upto)).cast("long"))
        .filter("_skip IS NULL")
        .drop("_bucket", "_skip")
    )


def global_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Add ``name``: 1, 2, 3, ... over the whole table in ``order``.

    The rows are range partitioned, sorted and written, which fixes their
    places; each partition's rows then count on from the sizes of the
    partitions before it, a table with one row per partition.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = saved(sorted_rows.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    # One row per partition, whatever Spark estimates: the rows themselves are not shuffled again.
    joined = fixed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, (F.col("_skip") + place + 1).cast("long")).drop("_id", "_part", "_skip")
