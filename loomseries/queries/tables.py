"""Reading the input tables, and the bar and tick series derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.numbering import DAY, time_then_id
from ..session import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, unit: str = "hour", keep: bool = True) -> DataFrame:
    """Open, high, low, close and volume per event type and hour (or day); ``keep`` writes them for several readers."""
    first = time_then_id("ts", "event_id")
    grouped = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("sym"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bar_ts"))
        .agg(
            F.min_by("value", first).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", first).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .withColumnRenamed("bar_ts", "ts")
    )
    # Far smaller than the events and read by several branches of most queries.
    return saved(grouped) if keep else grouped


# A bar series has at most one row per hour, so 90 days are at most 2160 rows of a key.
BAR_GRAIN = 90 * DAY


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one observation of its event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("sym"), "ts", "event_id", F.col("value").alias("real"), "user_id"
    )


# Events arrive without a limit, so their rows are numbered minute by minute.
TICK_GRAIN = 60_000_000


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    """Round the computed doubles; -0.0 becomes 0.0."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in columns})
