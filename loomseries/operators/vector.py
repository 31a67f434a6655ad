"""Exact vector search over ``array`` columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def unit(df: DataFrame, vector: str) -> DataFrame:
    """Replace vectors by unit vectors; those of length 0 become NULL.

    The length is its own generated column, so it is taken once per row and
    not once per element.
    """
    wide = F.col(vector).cast("array<double>")
    sized = df.withColumn("_size", F.explode(F.array(F.sqrt(dot(wide, wide)))))
    scaled = F.when(F.col("_size") > 0, F.transform(wide, lambda x: x / F.col("_size")))
    return sized.withColumn(vector, scaled).drop("_size")


def has_vector(column: str) -> Column:
    return F.size(F.coalesce(F.col(column), F.array())) > 0


def nearest(df: DataFrame, vector: str, ident: str, query: Sequence[float], k: int) -> DataFrame:
    """The ``k`` rows closest to one query vector by squared distance of the unit vectors.

    One pass over the table: each task keeps its best k. Ties go to the
    smaller id. A query vector without direction (zero or empty) is near nothing.
    """
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    target = F.array(*[F.lit(float(x) / size) for x in query if size]).cast("array<double>")
    wide = F.col(vector).cast("array<double>")
    near = F.try_divide(dot(wide, target), F.sqrt(dot(wide, wide)))
    # Between unit vectors the squared distance is 2 - 2 cos.
    scored = (
        df.filter(has_vector(vector))
        .select(ident, near.alias("cosine"))
        .filter("cosine IS NOT NULL")
        .select(ident, F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0)).alias("l2_sq"), "cosine")
    )
    return scored.orderBy("l2_sq", ident).limit(k)
