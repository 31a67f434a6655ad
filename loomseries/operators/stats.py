"""Running statistics, k-means and range aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.series import Series
from ..session import saved


def running_stats(s: Series, column: str) -> Series:
    """Mean, sample variance (0 for one value) and population variance of all rows so far.

    Sums are taken of the distances from the key's first value, which keeps
    them small; they run inside chunks and over chunk totals.
    """
    shifted = s.running_last(_k=F.when(F.col("rn") == 1, F.col(column)))
    away = F.col(column) - F.col("_k")
    sums = shifted.running_sum(_s1=away, _s2=away * away)
    n = F.col("rn").cast("double")
    spread = F.col("_s2") - F.col("_s1") * F.col("_s1") / n
    return sums.add(
        mean=F.col("_k") + F.col("_s1") / n,
        var_sample=F.when(F.col("rn") > 1, F.greatest(spread, F.lit(0.0)) / (n - F.lit(1.0))).otherwise(F.lit(0.0)),
        var_population=F.greatest(spread, F.lit(0.0)) / n,
    )


# -- k-means -------------------------------------------------------------
FEW_GROUPS = 200  # so many centroids are compared in one expression, more in blocks
BLOCK = 1024


def _assign_in_blocks(points: DataFrame, centroids: Sequence[tuple[int, float, float]]) -> DataFrame:
    """The same as ``_assign`` for any number of centroids: rows of a batch meet a block of them at a time."""
    names = np.array([g for g, _, _ in centroids], np.int32)
    places = np.array([(x, y) for _, x, y in centroids], float)
    shared = points.sparkSession.sparkContext.broadcast((names, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places = shared.value
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
            best, group = np.full(len(x), np.inf), np.full(len(x), names[0])
            for i in range(0, len(names), BLOCK):
                apart = (x[:, None] - places[i : i + BLOCK, 0]) ** 2 + (y[:, None] - places[i : i + BLOCK, 1]) ** 2
                at = np.where(np.isnan(apart), np.inf, apart).argmin(axis=1)
                near = apart[np.arange(len(x)), at]
                group = np.where(near < best, names[i : i + BLOCK][at], group)
                best = np.fmin(best, near)
            columns = [pa.array(group) if n == "group" else batch.column("group") if n == "old" else batch.column(n) for n in out]
            yield pa.RecordBatch.from_arrays(columns, out)

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields} | {"group": "int", "old": points.schema["group"].dataType.simpleString()}
    out = list(kinds)
    return points.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def _assign(points: DataFrame, centroids: Sequence[tuple[int, float, float]]) -> DataFrame:
    """Group of the nearest centroid; of equally near ones the first."""
    if len(centroids) > FEW_GROUPS:
        return _assign_in_blocks(points, centroids)
    best = [
        F.struct(
            ((F.col("x") - F.lit(x)) * (F.col("x") - F.lit(x)) + (F.col("y") - F.lit(y)) * (F.col("y") - F.lit(y))).alias("d"),
            F.lit(g).alias("g"),
        )
        for g, x, y in centroids
    ]
    nearest = best[0] if len(best) == 1 else F.least(*best)
    return points.withColumn("old", F.col("group")).withColumn("group", nearest["g"].cast("int"))


def centroids_of(points: DataFrame) -> DataFrame:
    return points.groupBy("group").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("size"))


def _means(points: DataFrame) -> list[tuple[int, float, float]]:
    """The means of the groups: three numbers a group pass the driver."""
    return [(r["group"], r["x"], r["y"]) for r in centroids_of(points).orderBy("group").collect()]


def kmeans_step(points: DataFrame) -> DataFrame:
    """Means of the current groups, then each point to the nearest; only the k means pass the driver."""
    return _assign(points, _means(points))


def kmeans(points: DataFrame) -> DataFrame:
    """Repeat from the given ``group`` of each ``(id, x, y)`` until at most n/10000 points change.

    A round is one pass over the points: it assigns them by the means before and
    by the newest ones, counts the changes, and sums up the new groups. Nothing
    but the means is kept from one round to the next.
    """
    points = saved(points)
    limit = points.count() / 10000
    before, means = None, _means(points)
    while means:
        last = points if before is None else _assign(points, before).drop("old")
        moved = _assign(last, means)
        rows = moved.groupBy("group").agg(
            F.avg("x").alias("x"), F.avg("y").alias("y"), F.count_if(F.col("group") != F.col("old")).alias("changed")).orderBy("group").collect()
        if sum(r["changed"] for r in rows) <= limit:
            return moved.drop("old")
        before, means = means, [(r["group"], r["x"], r["y"]) for r in rows]
    return points


# -- range aggregates ----------------------------------------------------
FAN = 4  # children per node of the block tree


def _merged(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"))


def _floor_div(a: str, b: str) -> str:
    """Whole-number division that rounds down, also below 0."""
    return f"(({a} - pmod({a}, {b})) div {b})"


def block_tree(data: DataFrame, position: str, value: str, levels: int) -> DataFrame:
    """Minimum, maximum and sum per block of ``FAN ** level`` positions, for every level.

    Each four levels are built from the highest one below them, so rows are
    repeated four times at most, and then only those of grouped blocks.
    """
    rows = data.select(F.col(position).cast("long").alias("block"), *[F.col(value).alias(n) for n in ("lo", "hi", "total")])
    places = _merged(rows, "block")
    tree = places.withColumn("level", F.lit(0))
    below, done = places.withColumn("block", F.expr(_floor_div("block", f"{FAN}L"))), 1
    below = _merged(below, "block")
    while done <= levels:
        top = min(done + 3, levels)
        some = below.withColumn("level", F.explode(F.sequence(F.lit(done), F.lit(top))))
        width = f"cast(pow({FAN}, level - {done}) AS bigint)"
        some = _merged(some.withColumn("block", F.expr(_floor_div("block", width))), "level", "block")
        tree = tree.unionByName(some)
        below = some.filter(F.col("level") == top).drop("level").withColumn("block", F.expr(_floor_div("block", f"{FAN}L")))
        below, done = _merged(below, "block"), top + 1
    return tree


def range_aggregate(
    data: DataFrame, position: str, value: str, queries: DataFrame, ident: str, first: str, last: str, levels: int = 16
) -> DataFrame:
    """Minimum, maximum and sum of ``value`` over positions ``first..last`` of each query.

    A range splits into few whole blocks of the tree, so each query joins on a
    small number of (level, block) keys, however long it is; the top level takes
    ranges beyond ``FAN ** levels``. A query whose range has no rows keeps its
    place, with the sum 0 and no minimum or maximum.
    """
    tree = block_tree(data, position, value, levels)
    asked = queries.select(
        ident, F.col(first).cast("long").alias("_lo"), (F.col(last).cast("long") + 1).alias("_hi"),
        F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    asked = asked.withColumn("_w", F.pow(F.lit(float(FAN)), F.col("level")).cast("long"))
    # Whole blocks of this level inside the range, and of the next level, which take the middle over.
    wide = f"(_w * {FAN})"
    asked = asked.selectExpr(
        f"{ident}", "level",
        f"{_floor_div('(_lo + _w - 1)', '_w')} AS a", f"{_floor_div('_hi', '_w')} AS b",
        f"{_floor_div(f'(_lo + {wide} - 1)', wide)} * {FAN} AS c", f"{_floor_div('_hi', wide)} * {FAN} AS d",
    ).filter("a < b")
    run = "IF({0} < {1}, sequence({0}, {1} - 1), cast(array() AS array<bigint>))"
    middle = f"c < d AND level < {levels}"
    blocks = f"IF({middle}, concat({run.format('a', 'c')}, {run.format('d', 'b')}), sequence(a, b - 1))"
    needed = asked.selectExpr(f"{ident}", "level", f"explode({blocks}) AS block")
    # Spark's size estimates do not see that rows are exploded, so no side is left to them for a broadcast.
    found = needed.hint("merge").join(tree, ["level", "block"]).select(ident, "lo", "hi", "total")
    every = queries.select(ident, *[F.lit(None).cast(found.schema[n].dataType).alias(n) for n in ("lo", "hi", "total")])
    return found.unionByName(every).groupBy(ident).agg(
        F.min("lo").alias("min_value"), F.max("hi").alias("max_value"), F.coalesce(F.sum("total"), F.lit(0)).alias("sum_value"))


def point_update(data: DataFrame, updates: DataFrame, position: str, value: str) -> DataFrame:
    """Data with the values of ``updates`` at their positions."""
    new = updates.select(position, F.col(value).alias("_new"))
    return data.join(new, position, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def arg_min_first(df: DataFrame, value: str, row: str, col: str) -> DataFrame:
    """Smallest value of a matrix in long form, at its first place by row and column."""
    place = F.struct(value, row, col)
    return df.agg(F.min(place).alias("m")).select("m.*")
