"""Session settings shared by tests, bench and the query entry points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# One folder per local session without a setting; each goes when Python ends.
_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(app: str = "loomseries", master: str = "local[8]", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder: on a cluster such a folder would be gone
    with its machine, so there the setting is required.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.TemporaryDirectory(prefix="loomseries-", ignore_cleanup_errors=True)
    return _local_dirs[app].name


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, under the application's own id so that it can be removed afterwards."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{kind}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later steps start from the files: the lineage ends here, the work is done
    once however many branches read it, and lost executors lose nothing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "tables")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class GrowingTable:
    """A table in the shared folder that an iteration appends to; batches are never rewritten."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = scratch_path(spark, "tables")
        self.schema = None
        self.batches = 0

    def append(self, df: DataFrame) -> DataFrame:
        """Write one batch and return it as read back from its files."""
        self.schema = self.schema or df.schema
        batch = f"{self.path}/batch={self.batches}"
        df.write.parquet(batch)
        self.batches += 1
        return self.spark.read.schema(self.schema).parquet(batch)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
