"""Connected components of a link table, by star rounds over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved


def _check(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


PART_EDGES = 200_000


def _few(df: DataFrame, edges: int) -> DataFrame:
    """A small table in few partitions: one for each ``PART_EDGES`` edges."""
    return df.coalesce(-(-edges // PART_EDGES))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id reachable.

    A large-star step links every larger neighbour of a node to its smallest
    one, a small-star step every smaller neighbour. Repeated, all components
    become stars; the number of rounds grows with the logarithm of their size.
    Each round is written to the shared folder. Only minima are taken per node,
    with partial results before the shuffle, so a node may have any number of
    links. Links of an id to itself give that id its own component; NULLs and
    repeated links don't count, and an empty table gives an empty result.
    """
    # Written with the links of ids to themselves, so that ``links`` is computed once.
    pairs = saved(
        links.where("a is not null and b is not null")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    edges = pairs.where("a <> b")
    before = _check(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Rounds never add edges.
        edges = saved(_few(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), before[0]))
        after = _check(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    alone = pairs.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots).unionByName(alone)
    return _few(found.groupBy("id").agg(F.min("component").alias("component")), max(1, before[0]))
