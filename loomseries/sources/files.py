"""Reading and writing the record files."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The union of the shapes seen in call logs; what a provider leaves out is NULL.
CALL_LOG = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("request", T.StructType([
        T.StructField("messages", T.ArrayType(T.StructType([
            T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
        T.StructField("model", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("response_model", T.StringType()),
        T.StructField("max_tokens", T.LongType()),
        T.StructField("input_tokens", T.LongType()),
    ])),
    T.StructField("response", T.StructType([
        T.StructField("content", T.StringType()),
        T.StructField("finish_reason", T.StringType()),
        T.StructField("usage", T.StructType([
            T.StructField("prompt_tokens", T.LongType()),
            T.StructField("completion_tokens", T.LongType()),
            T.StructField("total_tokens", T.LongType()),
        ])),
        T.StructField("response_id", T.StringType()),
        T.StructField("created", T.LongType()),
    ])),
])


def read_sources(spark: SparkSession, path: str, glob: str = "*.c") -> DataFrame:
    """``(path, text)`` of the matching files under ``path``, at any depth."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def subject_sources(sources: DataFrame) -> DataFrame:
    """Files of each folder that are no tests; a folder without files of its own takes those of its ``src``."""
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    inner = F.regexp_extract("_dir", "^(.*)/src$", 1)
    named = sources.withColumn("_dir", parent)
    named = named.withColumn("subject", F.when(inner != "", inner).otherwise(F.col("_dir"))).withColumn("_deep", inner != "")
    outer = named.filter("NOT _deep").select("subject").distinct()
    chosen = named.filter("NOT _deep").unionByName(named.filter("_deep").join(outer, "subject", "left_anti"))
    return chosen.filter(~name.startswith("test")).drop("_dir", "_deep")


def write_named(rows: DataFrame, path: str) -> None:
    """Write ``(name, no, text)`` as one file per name under ``path``: its texts in the order of ``no``.

    A file appears under its name when it is whole, so a repeated task replaces
    it. ``path`` is a URI, or a path on a file system that all executors share.
    """
    root = path if "://" in path else f"file://{path}" if path.startswith("/") else path

    def put(store, folder, name, out_path):
        store.move(out_path, f"{folder}/{name}")
        return name

    def write(batches):
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        now, out, part = None, None, None
        for batch in batches:
            done = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != now:
                    if out is not None:
                        out.close()
                        done.append(put(store, folder, now, part))
                    now, part = name, f"{folder}/{name}.{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(part)
                out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["name"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([put(store, folder, now, part)], pa.string())], ["name"])

    ordered = rows.select("name", "text", "no").repartition("name").sortWithinPartitions("name", "no").select("name", "text")
    ordered.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def read_call_log(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Calls from files of one document each, or, with ``lines``, of one call per line as ``append_call_log`` writes them."""
    return spark.read.schema(CALL_LOG).option("multiLine", str(not lines).lower()).json(path)


def append_call_log(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").json(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """``subject,path_count`` with a header."""
    counts.select("subject", "path_count").write.csv(path, header=True)


def write_matrix(rows: DataFrame, cells: str, path: str) -> None:
    """Rows of numbers as comma text with at most four significant digits and no trailing zeros."""

    @F.pandas_udf(T.StringType())
    def line(values: pd.Series) -> pd.Series:
        return pd.Series([",".join("%.4g" % x for x in row) if row is not None else None for row in values])

    rows.select(line(F.col(cells).cast("array<double>")).alias("value")).write.text(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Numbered lines ``(no, line)`` as text, in order over the part files."""
    lines.repartitionByRange("no").sortWithinPartitions("no").select("line").write.text(path)


def save_vectors(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_batch(path: str):
    """For ``foreachBatch``: each batch is its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
