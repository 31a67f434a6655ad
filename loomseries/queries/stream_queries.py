"""Stateful streams over the events and over bars, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.stateful import OpenStream, run_available
from .indicator_queries import case_sql
from .numeric_queries import SQL as NUMERIC
from .numeric_queries import rounded_stats
from .tables import bars, rounded, table

TICK_KEYS = (["sym"], ["ts", "event_id"])


def tick_stream(spark, sf_dir):
    """The events table as a stream of files: a folder of part files, or a lone file picked out of its folder."""
    events = table(spark, sf_dir, "events")
    files = events.inputFiles()
    if not files:
        raise FileNotFoundError(f"no files in {sf_dir}/events.parquet")
    reader = spark.readStream.schema(events.schema)
    lone = len(files) == 1 and files[0].rsplit("/", 1)[1] == "events.parquet"
    if lone:
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        # All files in one batch: part files are in no order of time.
        stream = reader.parquet(f"{sf_dir}/events.parquet")
    return stream.select(F.col("event_type").alias("sym"), "ts", "event_id", F.col("value").alias("real"))


def bar_stream(spark, sf_dir):
    made = bars(spark, sf_dir)
    folder = made.inputFiles()[0].rsplit("/", 1)[0]
    # All bars in one batch: the part files of one table are in no order of time.
    return spark.readStream.schema(made.schema).parquet(folder)


def stream_sma(spark, sf_dir):
    out = run_available(OpenStream("sma", [5], *TICK_KEYS).run(tick_stream(spark, sf_dir)))
    return rounded(out.select("sym", "event_id", "sma"), ["sma"])


def stream_atr(spark, sf_dir):
    out = run_available(OpenStream("atr", [5], ["sym"], ["ts"]).run(bar_stream(spark, sf_dir)))
    return rounded(out, ["atr"])


def stream_stats(spark, sf_dir):
    out = run_available(OpenStream("stats", [], *TICK_KEYS).run(tick_stream(spark, sf_dir)))
    return rounded_stats(out)


def stream_progress(spark, sf_dir):
    out = run_available(OpenStream("sma", [5], *TICK_KEYS).progress(tick_stream(spark, sf_dir)))
    return out.groupBy("sym").agg(F.max("progress").cast("long").alias("progress"))


def queries() -> dict:
    return {"stream_sma": stream_sma, "stream_atr": stream_atr, "stream_stats": stream_stats, "stream_progress": stream_progress}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_sma": case_sql("sma"),
        "stream_atr": case_sql("atr"),
        "stream_stats": NUMERIC["running_stats"],
        "stream_progress": "SELECT event_type AS sym, count(*) - 4 AS progress FROM events GROUP BY 1",
    }
