"""A stored tree of blocks for range aggregates with a combine function of the caller.

Values are short vectors of numbers. ``combine(left, right)`` takes two
matrices, a vector per row, and must be associative; it need not commute, so
the order of positions is kept throughout. A block of level l stands for
``FAN ** l`` positions and holds their values combined; positions without a
value count as the identity.

Each level is a table in folders by version and part (a stretch of blocks). An
update writes the changed positions as a new version, then for each level the
blocks above them, for which it reads the parts with their children alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN = 8
PART = 1 << 20  # blocks per part
GROUP = FAN << 12  # blocks folded in one task at most
LEVELS = 32  # more than a tree over 64-bit positions has

Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


def fold_runs(keys: np.ndarray, values: np.ndarray, combine: Combine) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal ``keys``, and each run's values combined in order: neighbours first, then their results."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(keys)))
    while len(run) > len(starts):
        first = np.searchsorted(run, run)
        even = (np.arange(len(run)) - first) % 2 == 0
        left = np.flatnonzero(even)
        paired = np.zeros(len(left), bool)
        inside = left + 1 < len(run)
        paired[inside] = run[left[inside] + 1] == run[left[inside]]
        out = values[left].copy()
        out[paired] = combine(values[left[paired]], values[left[paired] + 1])
        run, values = run[left], out
    return starts, values


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(at, pa.array(values.ravel(), kind))


@dataclass(frozen=True)
class Tree:
    spark: SparkSession
    path: str
    combine: Combine
    identity: tuple
    levels: int = 0
    version: int = 0
    whole: bool = True  # numbers are longs, else doubles
    part: int = PART

    @property
    def kind(self) -> pa.DataType:
        return pa.int64() if self.whole else pa.float64()

    @property
    def schema(self) -> str:
        return f"block long, value array<{'long' if self.whole else 'double'}>"

    # -- tables ---------------------------------------------------------
    def _write(self, level: int, rows: DataFrame) -> None:
        parted = rows.select("block", "value").withColumn("part", F.expr(f"floor(block / {self.part})").cast("long"))
        parted.repartition("part", F.pmod("block", F.lit(64))).sortWithinPartitions("part", "block").write.partitionBy("part").parquet(
            f"{self.path}/level={level}/version={self.version}")

    def rows(self, level: int, parts: Sequence[int] | None = None) -> DataFrame:
        """(block, value) of a level as of the newest version, of these parts or of all."""
        schema = T.StructType.fromDDL(f"{self.schema}, version int, part long")
        found = self.spark.read.schema(schema).parquet(f"{self.path}/level={level}").where(F.col("version") <= self.version)
        if parts is not None:
            found = found.where(F.col("part").isin(list(parts)))
        if self.version == 0:
            return found.select("block", "value")
        return found.groupBy("block").agg(F.max_by("value", "version").alias("value"))

    def _parents(self, children: DataFrame) -> DataFrame:
        """One level up; a task folds the children of neighbouring blocks."""
        width, combine, kind = len(self.identity), self.combine, self.kind

        def fold(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("block")
            above = rows["block"].to_numpy() // FAN
            starts, values = fold_runs(above, _matrix(rows["value"], width), combine)
            return pa.table([pa.array(above[starts]), _lists(values, kind)], ["block", "value"])

        return children.groupBy(F.expr(f"floor(block / {GROUP})")).applyInArrow(fold, self.schema)

    # -- operations -----------------------------------------------------
    def update(self, changes: DataFrame, position: str, value: str) -> Tree:
        """Put new values (an array, one per position); only blocks above them are computed anew."""
        new = replace(self, version=self.version + 1)
        changed = changes.select(F.col(position).cast("long").alias("block"), F.col(value).alias("value"))
        new._write(0, changed)
        for level in range(1, self.levels + 1):
            mine = self.spark.read.schema(T.StructType.fromDDL(f"{self.schema}, part long")).parquet(f"{self.path}/level={level - 1}/version={new.version}")
            parts = [r[0] for r in mine.select(F.expr(f"floor(block / {self.part})").cast("long")).distinct().collect()]
            above = mine.select(F.expr(f"floor(block / {FAN})").alias("above")).distinct()
            children = new.rows(level - 1, parts)
            touched = children.join(above, F.expr(f"floor(block / {FAN})") == above["above"], "left_semi")
            new._write(level, new._parents(touched))
        return new

    def ranges(self, queries: DataFrame, ident: str, first: str, last: str) -> DataFrame:
        """(ident, value): the values at ``first..last`` of each query combined in order; the identity where there are none.

        A range is cut into whole blocks, few per level, and these are joined by
        level and block. Idents are different; a range with a NULL end is empty.
        """
        asked = queries.select(F.col(ident).alias("id"), F.col(first).cast("long").alias("lo"), (F.col(last).cast("long") + 1).alias("hi"))
        cut = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(self.levels)))).withColumn("w", F.pow(F.lit(float(FAN)), F.col("level")).cast("long"))
        cut = cut.selectExpr(
            "id", "level", "w", "ceil(lo / w) AS a", "floor(hi / w) AS b", f"ceil(lo / (w * {FAN})) * {FAN} AS c", f"floor(hi / (w * {FAN})) * {FAN} AS d").filter("a < b")
        run = "IF({0} < {1}, sequence({0}, {1} - 1), cast(array() AS array<bigint>))"
        blocks = f"IF(c < d AND level < {self.levels}, concat({run.format('a', 'c')}, {run.format('d', 'b')}), sequence(a, b - 1))"
        needed = cut.selectExpr("id", "level", "w", f"explode({blocks}) AS block")
        held = [self.rows(level).withColumn("level", F.lit(level)) for level in range(self.levels + 1)]
        every = held[0]
        for more in held[1:]:
            every = every.unionByName(more)
        # Spark's size estimates do not see that rows are exploded, so no side is left to them for a broadcast.
        # Level and block in one number, which Spark sorts by its bits; levels alone are the same for most rows.
        key = (F.col("block") * F.lit(LEVELS) + F.col("level")).alias("level_block")
        met = needed.select("id", "w", "block", key).hint("merge").join(every.select(key, "value"), "level_block").select("id", (F.col("block") * F.col("w")).alias("at"), "value")
        width, combine, kind = len(self.identity), self.combine, self.kind
        name = met.schema["id"].dataType.simpleString()

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_id = open_value = None  # of the last query, which may go on in the next batch
            for batch in batches:
                ids = batch.column(0)
                if not len(ids):
                    continue
                codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
                starts, values = fold_runs(codes, _matrix(batch.column(2), width), combine)
                names = ids.take(pa.array(starts))
                if open_value is not None and names[0].equals(open_id[0]):
                    values[:1] = combine(open_value, values[:1])
                elif open_value is not None:
                    names, values = pa.concat_arrays([open_id, names]), np.concatenate([open_value, values])
                open_id, open_value = names[-1:], values[-1:]
                yield pa.RecordBatch.from_arrays([names[:-1], _lists(values[:-1], kind)], ["id", "value"])
            if open_value is not None:
                yield pa.RecordBatch.from_arrays([open_id, _lists(open_value, kind)], ["id", "value"])

        folded = met.repartition("id").sortWithinPartitions("id", "at").mapInArrow(fold, f"id {name}, value array<{'long' if self.whole else 'double'}>")
        none = F.array(*[F.lit(x) for x in self.identity]).cast(f"array<{'long' if self.whole else 'double'}>")
        out = asked.select("id").join(folded.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left")
        return out.select(F.col("id").alias(ident), F.coalesce("value", none).alias("value"))


def build(data: DataFrame, position: str, value: str, path: str, combine: Combine, identity: Sequence[float], whole: bool = True, part: int = PART) -> Tree:
    """Write the tree over ``data`` (an array ``value`` per different ``position``) to a new folder."""
    if part % FAN:
        raise ValueError(f"parts must hold whole blocks of {FAN}")
    tree = Tree(data.sparkSession, path, combine, tuple(identity), whole=whole, part=part)
    tree._write(0, data.select(F.col(position).cast("long").alias("block"), F.col(value).alias("value")).filter("block is not null and value is not null"))
    ends = tree.rows(0).agg(F.min("block"), F.max("block")).first()
    low, high, level = ends[0] or 0, ends[1] or 0, 0
    while high - low >= FAN:  # the top level keeps a few blocks, also on both sides of 0
        low, high, level = low // FAN, high // FAN, level + 1
        tree._write(level, tree._parents(tree.rows(level - 1)))
    return replace(tree, levels=level)
