"""Shards by a weighted hash tree of regions, racks and shards.

Every document descends the tree. At each level the children of its node draw
ln(u) / weight, where u is a uniform number from the hash of the key, the
level and the child; the largest draw wins. A child wins in proportion to its
weight. When a weight changes, the other children's draws stay what they were,
so rows move only into or out of the subtree whose weight has changed.

Inside such a subtree a row that has just come in draws among all children. A
shard that is added as a region of its own (``grow``) therefore takes rows
only into itself, and no row moves between the shards that were there.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Shard(NamedTuple):
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def balanced_tree(regions: int, racks: int, shards: int) -> list[Shard]:
    """``regions`` with ``racks`` each with ``shards`` each, numbered from 0; all weights 1."""
    return [Shard(i, i // (racks * shards), i // shards % racks) for i in range(regions * racks * shards)]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one shard more, which opens a region."""
    return [*tree, Shard(max(s.shard for s in tree) + 1, max(s.region for s in tree) + 1, 0, weight)]


def _levels(tree: list[Shard]) -> tuple[list[tuple], dict, dict]:
    """(child, weight) lists: of the root, of each region and of each (region, rack); weights add up."""
    racks, leaves = defaultdict(lambda: defaultdict(float)), defaultdict(list)
    for s in tree:
        if s.weight > 0:
            racks[s.region][s.rack] += s.weight
            leaves[s.region, s.rack].append((s.shard, s.weight))
    if not racks:
        raise ValueError("the tree has no shard with a weight above 0")
    root = [(r, sum(w.values())) for r, w in sorted(racks.items())]
    return root, {r: sorted(w.items()) for r, w in racks.items()}, {k: sorted(v) for k, v in leaves.items()}


def _children(pairs: list[tuple]) -> Column:
    return F.array(*[F.struct(F.lit(int(c)).alias("id"), F.lit(float(w)).alias("w")) for c, w in pairs])


def _winner(children: Column, key: Column, level: str) -> Column:
    """The child with the largest draw; of equal draws the smaller child."""

    def draw(child):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child["id"]), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.log(u) / child["w"]).alias("draw"), (-child["id"]).alias("id"))

    return -F.array_max(F.transform(children, draw))["id"]


def place(docs: DataFrame, key: str, tree: list[Shard], name: str = "shard") -> DataFrame:
    """Add the shard of every row. The key and the tree decide, so equal keys share a shard; a NULL key has one too."""
    root, racks, leaves = _levels(tree)
    by_region = F.create_map(*[x for r, v in sorted(racks.items()) for x in (F.lit(r), _children(v))])
    by_rack = F.create_map(*[
        x for (r, k), v in sorted(leaves.items()) for x in (F.lit(f"{r}/{k}"), _children(v))])
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    region, rack = f"_region_{name}", f"_rack_{name}"
    return (
        docs.withColumn(region, _winner(_children(root), ident, "region"))
        .withColumn(rack, _winner(F.element_at(by_region, F.col(region)), F.concat_ws("/", ident, region), "rack"))
        .withColumn(name, _winner(
            F.element_at(by_rack, F.concat_ws("/", region, rack)), F.concat_ws("/", ident, region, rack), "shard"))
        .drop(region, rack)
    )


def number_slots(placed: DataFrame, shard: str, order: list[str], rows: int, bucket_rows: int = 2000) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... per shard, without a gap.

    Rows of a shard are dealt into buckets of about ``bucket_rows`` by the hash
    of ``order``, numbered there, and shifted by the sizes of earlier buckets.
    Rows with the same ``order`` share a bucket; their slots differ.
    """
    shards = max(1, placed.select(shard).distinct().count())
    buckets = max(1, -(-rows // (shards * bucket_rows)))
    cut = placed.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    skips = sizes.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order)
    return (
        cut.withColumn("_place", F.row_number().over(inside))
        .join(skips, [shard, "_bucket"])
        .withColumn("slot", (F.col("_place") - 1 + F.col("_skip")).cast("long"))
        .drop("_bucket", "_place", "_skip")
    )


def assign(docs: DataFrame, tree: list[Shard]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text).

    The law is ``key``: doc_id and the tree decide. Size is the UTF-8 bytes of
    the text plus 16; a NULL text counts 0 bytes and has the CRC of no bytes.
    Repeated rows get one shard and slots of their own, a NULL doc_id is a key
    like any other, and an empty table gives an empty result. Other columns of
    ``docs`` are not looked at, whatever their names are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(place(sized, "doc_id", tree), "doc_id", grow(tree), "grown_shard")
    return number_slots(placed, "shard", ["doc_id", "text_crc32", "size"], docs.count()).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
