"""An inverted-list index over vectors: search few lists instead of all rows.

The lists' centres come from k-means on a bounded sample of unit vectors; every
row is then filed under its nearest centre. A search looks into the ``probes``
nearest lists of each query. With as many probes as lists it is exact. All
queries are searched in one pass.

An index is kept as Parquet: the centres, and the rows in one folder per list,
so that a search after loading reads the folders of the probed lists alone.
Lists may also hold graphs (``vector_graph``); then a search walks these.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import saved
from . import vector_graph

SAMPLE = 20_000  # rows that the centres are fitted on, at most
ROUNDS = 15
BLOCK = 2048  # rows of a list that are compared at once
PLACES = 9  # decimal places of a cosine that count, so that equal vectors tie


class Index(NamedTuple):
    centres: np.ndarray
    rows: DataFrame  # id, v (unit vector), list, block, other kept columns; in a graph also place, links


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1).astype(float) if len(column) else np.zeros((0, 0))


def _units(df: DataFrame, ident: str, vector: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, v): vectors as doubles of length 1; those without a direction or with a NULL are left out."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    sized = df.select(F.col(ident).alias("id"), wide.alias("v"), size.alias("_n"), *keep).where("_n > 0 and _n < double('infinity')")
    return sized.select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v"), *keep)


def _centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means from a fixed start; an empty list keeps its centre."""
    centres = sample[np.random.default_rng(1).permutation(len(sample))[:lists]].copy()
    for _ in range(ROUNDS):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def build(
    df: DataFrame, ident: str, vector: str, lists: int | None = None, sample: int = SAMPLE, keep: Sequence[str] = (), block: int = BLOCK
) -> Index:
    """File every row, with the columns ``keep``; ``lists`` defaults to the square root of the rows.

    The filed rows are written, so that rows have fixed places: a list of more
    than ``block`` rows is cut into as many blocks as it needs, and no task
    holds all of it, whatever the ids are.
    """
    units = _units(df, ident, vector, keep)
    n = max(1, units.count())
    lists = lists or max(1, int(n**0.5))
    drawn = units.where(F.xxhash64("id") / 2.0**64 + 0.5 <= min(1.0, sample / n)).orderBy(F.xxhash64("id"), "id").limit(sample)
    found = np.array([r.v for r in drawn.select("v").collect()], float)  # at most ``sample`` vectors
    centres = _centres(found, lists) if len(found) else np.zeros((0, 0))

    def file(batches):
        for batch in batches:
            near = np.argmax(_matrix(batch.column(1)) @ centres.T, axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "list"])

    kept = "".join(f", `{c}` {units.schema[c].dataType.simpleString()}" for c in keep)
    filed = units.mapInArrow(file, f"id {units.schema['id'].dataType.simpleString()}, v array<double>{kept}, list int")
    filed = saved(filed.withColumn("_row", F.monotonically_increasing_id()))
    sizes = filed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    placed = filed.join(F.broadcast(sizes), "list")  # one row a list, as many as there are centres
    return Index(centres, placed.withColumn("block", F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int")).drop("_row", "_blocks"))


def with_graphs(index: Index, degree: int = vector_graph.DEGREE) -> Index:
    """The same index with a proximity graph in every block of a list."""
    return Index(index.centres, saved(vector_graph.link_blocks(index.rows, ["list", "block"], degree)))


def save(index: Index, path: str) -> None:
    """Write the index: its centres, and its rows in a folder per list."""
    spark = index.rows.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(index.centres)], "list int, centre array<double>")
    centres.coalesce(1).write.parquet(f"{path}/centres")
    index.rows.repartition("list", "block").sortWithinPartitions("list", "block").write.partitionBy("list").parquet(f"{path}/rows")


def load(spark: SparkSession, path: str) -> Index:
    """The index in a folder; its rows are read when searched, and only those of probed lists."""
    centres = sorted(spark.read.parquet(f"{path}/centres").collect())  # one row a list
    if not centres:
        return Index(np.zeros((0, 0)), spark.createDataFrame([], "id long, v array<double>, list int, block int"))
    return Index(np.array([c.centre for c in centres], float), spark.read.parquet(f"{path}/rows"))


def probed_rows(index: Index, lists: Sequence[int]) -> DataFrame:
    """The rows of these lists; of a loaded index other folders are not read."""
    return index.rows if len(lists) == len(index.centres) else index.rows.where(F.col("list").isin(list(lists)))


def search(
    index: Index, queries: DataFrame, ident: str, vector: str, k: int, probes: int, keep: Sequence[str] = (), beam: int | None = None
) -> DataFrame:
    """query_id, rank, id, cosine, compared: the ``k`` rows most like each query, other than itself; ties go to the smaller id.

    ``keep`` names kept columns of the index that are returned as well.
    ``compared`` is the number of rows the query was compared with. In an index
    with graphs ``beam`` is the number of best rows from which a search goes on.
    """
    asked = _units(queries, ident, vector)
    kind = asked.schema["id"].dataType.simpleString()
    centres, names = index.centres, ["query_id", "id", "cosine", "compared", *keep]
    kept = "".join(f", `{c}` {index.rows.schema[c].dataType.simpleString()}" for c in keep)
    found = f"query_id {kind}, id {index.rows.schema['id'].dataType.simpleString()}, cosine double, compared long{kept}"

    def probe(batches):
        for batch in batches:
            n = batch.num_rows
            some = min(probes, len(centres))
            near = np.argsort(-(_matrix(batch.column(1)) @ centres.T), axis=1, kind="stable")[:, :some] if n else np.zeros((0, some), int)
            at = pa.array(np.repeat(np.arange(n), some))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(near.ravel().astype(np.int32))], ["id", "v", "list"])

    probed = asked.mapInArrow(probe, f"id {kind}, v array<double>, list int")
    rows = index.rows
    if probes < len(centres):
        probed = saved(probed)
        rows = probed_rows(index, [r[0] for r in probed.select("list").distinct().collect()])  # at most as many as there are centres
    wanted = probed.join(rows.select("list", F.col("block").alias("piece")).distinct(), "list")
    width, linked = k + 1, "links" in rows.columns
    beam = max(width, beam or vector_graph.BEAM)

    def compare(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(rows) or not len(wanted):
            empty = [pa.array([], wanted["id"].type), pa.array([], rows["id"].type), pa.array([], pa.float64()), pa.array([], pa.int64())]
            return pa.table([*empty, *(rows[c].slice(0, 0) for c in keep)], names)
        vectors, parts = _matrix(wanted["v"]), []
        rows = rows.sort_by("place" if linked else "id")
        held = _matrix(rows["v"])
        graph = vector_graph.neighbours(rows["links"].combine_chunks()) if linked else None
        for first in range(0, len(vectors), vector_graph.QUERIES):
            some = vectors[first : first + vector_graph.QUERIES]
            if linked:
                at, near, compared = vector_graph.walk(held, graph, some, width, beam)
            else:
                near = np.round(some @ held.T, PLACES)
                at = np.argsort(-near, axis=1, kind="stable")[:, :width]
                near, compared = np.take_along_axis(near, at, 1), np.full(len(some), len(held))
            # A query's comparisons in this block stand in its first row.
            counts = np.zeros(at.shape, np.int64)
            counts[:, 0] = compared
            ok = at.ravel() >= 0
            of = pa.array(np.repeat(np.arange(first, first + len(some)), at.shape[1])[ok])
            to = pa.array(at.ravel()[ok])
            parts.append(pa.table(
                [wanted["id"].take(of), rows["id"].take(to), pa.array(np.round(near.ravel()[ok], PLACES)), pa.array(counts.ravel()[ok]), *(rows[c].take(to) for c in keep)], names))
        return pa.concat_tables(parts)

    cells = rows.groupBy("list", "block").cogroup(wanted.groupBy("list", "piece")).applyInArrow(compare, found)
    whole = Window.partitionBy("query_id")
    order = whole.orderBy(F.desc("cosine"), "id")
    counted = cells.withColumn("compared", F.sum("compared").over(whole)).where("id <> query_id")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "cosine", "compared", *keep)
