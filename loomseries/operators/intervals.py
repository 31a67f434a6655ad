"""Lookups of positions in intervals and in sorted starts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.series import CHUNK_ROWS, Series


def asof_last(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    at: str,
    ident: str,
    columns: Sequence[str],
    grain: int,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Each left row with the ``columns`` of the newest right row of its key at or before ``at``.

    Both sides are laid into one series, in which the value of the newest
    right row is carried forward. No pair of rows is formed, and a dominant
    key is cut into chunks. Of right rows at one time the largest ``ident``
    counts. A left row keeps its place with a NULL key (which matches NULL keys)
    and with a NULL time (which comes before all others).
    """
    keys = list(key)
    payload = F.struct(*columns)
    left_id, right_id = F.col(ident), F.col(ident)
    if left.schema[ident].dataType != right.schema[ident].dataType:
        # Ids are only compared within a side; the left ones have to have a type that fits.
        left_id = F.lit(None).cast(right.schema[ident].dataType)
    lefts = left.select(*keys, at, F.lit(1).alias("_side"), left_id.alias("_id"),
                        F.struct(*[c for c in left.columns if c not in (*keys, at)]).alias("_left"))
    rights = right.select(*keys, at, F.lit(0).alias("_side"), right_id.alias("_id"),
                          payload.alias("_right"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    s = Series.of(both, keys, [at, "_side", "_id"], grain, chunk_rows).running_last(_found=F.col("_right"))
    names = [F.col(f"_found.{c}").alias(c) for c in columns]
    return s.df.filter("_side = 1").select(*keys, at, "_left.*", *names)


TILE_BITS = 12  # 4,096 positions; what a task holds of a key's intervals is one number for each of them


def _covers(tiles: DataFrame, long: DataFrame, key: str) -> DataFrame:
    """The narrowest of the intervals ``(key, node_id, start, stop, first, last)`` that hold a whole tile ``first < tile < last``, for each of ``(key, tile)``.

    An interval is filed under the power of two at or above its number of tiles, where it touches at most two
    buckets of that width; a tile looks into its one bucket per width in use.
    """
    inner = long.withColumn("scale", F.ceil(F.log2((F.col("last") - F.col("first") - 1).cast("double"))).cast("int"))
    filed = inner.withColumn("bucket", F.explode(F.expr("sequence(shiftright(first + 1, scale), shiftright(last - 1, scale))")))
    probes = tiles.hint("merge").join(filed.select(key, "scale").distinct(), key).withColumn("bucket", F.expr("shiftright(tile, scale)"))
    found = probes.hint("merge").join(filed, [key, "scale", "bucket"]).filter("first < tile AND tile < last")
    order = F.struct((F.col("stop") - F.col("start")).alias("w"), (-F.col("start")).alias("s"), F.col("node_id").alias("n"), "start", "stop")
    return found.groupBy(key, "tile").agg(F.min(order).alias("b")).select(key, "tile", F.col("b.n").alias("node_id"), "b.start", "b.stop")


def _differs(column: pa.Array) -> np.ndarray:
    """Which values of a column differ from the one before; the first one does."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tile, point_id, pos, node_id, start, stop) in the order of tiles, a tile's intervals ahead of its points, the best one last.

    Each interval overwrites its positions in the tile; a point reads its own. Points that come twice are one.
    """
    size = 1 << TILE_BITS
    best = np.full(size, -1)  # by position of the tile, the place of its interval among the ``names``
    tile = point = names = widths = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.table({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
        key = [rows[c].combine_chunks() for c in (rows.column_names[0], "tile")]
        new_tile = _differs(key[0]) | _differs(key[1])
        new_tile[0] = tile is None or not all(c[0].equals(t) for c, t in zip(key, tile, strict=True))
        base = key[1].to_numpy() << TILE_BITS
        pos = rows["pos"].combine_chunks()
        is_point = pos.is_valid().to_numpy(zero_copy_only=False)
        start, stop, at = (pc.fill_null(rows[c], 0).to_numpy() - base for c in ("start", "stop", "pos"))
        low, high = np.clip(start, 0, size).tolist(), np.clip(stop, 0, size).tolist()
        ident = rows["point_id"].combine_chunks()
        fresh = new_tile | _differs(ident) | _differs(pos)
        fresh[0] = new_tile[0] or point is None or not (ident[0].equals(point[0]) and pos[0].equals(point[1]))
        held = 0 if names is None else len(names)
        names = rows["node_id"].combine_chunks() if names is None else pa.concat_arrays([names, rows["node_id"].combine_chunks()])
        widths = stop - start if widths is None else np.concatenate([widths, stop - start])
        # Runs of intervals and of points, by tile.
        cuts = np.flatnonzero(new_tile | np.concatenate([[True], is_point[1:] != is_point[:-1]])).tolist()
        met = np.full(batch.num_rows, -1)
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            if new_tile[a]:
                best.fill(-1)
            if is_point[a]:
                met[a:b] = best[at[a:b]]
            else:
                for i in range(a, b):
                    best[low[i] : high[i]] = held + i
        some = np.flatnonzero(is_point & fresh)
        place = pa.array(met[some], mask=met[some] < 0)
        yield pa.RecordBatch.from_arrays(
            [key[0].take(pa.array(some)), ident.take(pa.array(some)), pos.take(pa.array(some)), names.take(place), pa.array(widths).take(place)],
            [batch.schema.names[0], "point_id", "pos", "node_id", "width"])
        tile, point = [c[-1] for c in key], (ident[-1], pos[-1])
        kept, places = np.unique(best, return_inverse=True)
        skip = int(kept[0] < 0)
        names, widths, best = names.take(pa.array(kept[skip:])), widths[kept[skip:]], places.reshape(-1) - skip


def narrowest_interval(points: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Each point ``(key, point_id, pos)`` with its narrowest ``[start, stop)`` of ``(key, node_id, start, stop)``.

    Positions are cut into tiles. An interval goes to the two tiles in which it
    starts and ends; of those that hold a tile as a whole, only the narrowest
    goes there. So every point is shuffled once, and a task keeps one number per
    position of a tile. Ties go to the later start, then the smaller id. A point
    outside all intervals, or without a key, keeps its place with NULLs.
    """
    kinds = {n: points.schema[n].dataType for n in (key, "point_id", "pos")}
    tile_of = lambda c: F.expr(f"shiftright({c}, {TILE_BITS})")
    placed = points.select(key, "point_id", F.col("pos").cast("long").alias("pos"))
    there = placed.filter(F.col(key).isNotNull() & F.col("pos").isNotNull()).withColumn("tile", tile_of("pos"))
    name = nodes.schema["node_id"].dataType
    sized = nodes.filter(F.col(key).isNotNull()).select(key, "node_id", *[F.col(c).cast("long").alias(c) for c in ("start", "stop")]).filter("stop > start")
    sized = sized.withColumn("first", tile_of("start")).withColumn("last", tile_of("stop - 1"))
    ends = sized.withColumn("tile", F.explode(F.array_distinct(F.array("first", "last")))).select(key, "tile", "node_id", "start", "stop")
    covers = _covers(there.select(key, "tile").distinct(), sized.filter("last > first + 1"), key)
    rows = there.unionByName(ends, allowMissingColumns=True).unionByName(covers, allowMissingColumns=True)
    order = [key, "tile", F.col("pos").isNotNull(), F.desc(F.col("stop") - F.col("start")), "start", F.desc("node_id"), "pos", "point_id"]
    dealt = rows.select(key, "tile", "point_id", "pos", "node_id", "start", "stop").repartition(key, "tile").sortWithinPartitions(*order)
    plain = T.StructType([
        T.StructField(key, kinds[key]), T.StructField("point_id", kinds["point_id"]), T.StructField("pos", T.LongType()),
        T.StructField("node_id", name), T.StructField("width", T.LongType())])
    nowhere = placed.filter(F.col(key).isNull() | F.col("pos").isNull()).distinct()
    found = dealt.mapInArrow(_looked_up, plain).unionByName(nowhere, allowMissingColumns=True)
    width = nodes.select((F.col("stop") - F.col("start")).alias("w")).schema["w"].dataType
    return found.select(key, "point_id", F.col("pos").cast(kinds["pos"]).alias("pos"), "node_id", F.col("width").cast(width).alias("width"))
