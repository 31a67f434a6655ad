"""Entries that meet in nodes: many small groups, formed without a row per entry.

An entry is a fixed-size record with a ``node`` (a hash) and a ``member``. Most
nodes have one entry and are of no further use. So entries travel as packed
arrays, one for each batch and part, and are sorted by numpy where they meet;
only those of nodes with two members or more become rows.

Nodes with ``HOT`` entries or more are counted first (per batch, then in all)
and go by way of Spark's own joins, which can split them. There can't be more
such nodes than entries / ``HOT``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = np.dtype([("node", "<i8"), ("member", "<i8")])
HOT = 2_000_000  # entries of 16 bytes
PART_ENTRIES = 500_000

Maker = Callable[[pa.RecordBatch], np.ndarray]
ROWS = "node long, member long, size long, first long"


def unique(entries: np.ndarray) -> np.ndarray:
    """Entries sorted by node and member, each once."""
    entries = entries[np.lexsort((entries["member"], entries["node"]))]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["node"][1:] != entries["node"][:-1]) | (entries["member"][1:] != entries["member"][:-1])
    return entries[new]


def _packed(records: np.ndarray, parts: int, name: str) -> pa.RecordBatch:
    """Records with a node as one binary value for each part."""
    part = np.ascontiguousarray(records["node"]).view(np.uint64) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(cuts))
    data = [records[order[cuts[i] : cuts[i + 1]]].tobytes() for i in some]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(data, pa.binary())], ["part", name])


def _joined(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    found = [np.frombuffer(x.as_buffer(), kind) for batch in batches for x in batch.column(1)]
    return np.concatenate(found) if found else np.zeros(0, kind)


def _runs(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal nodes."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(node)), bool), node[1:] != node[:-1]]))
    return starts, np.diff(np.append(starts, len(node)))


_COUNT = np.dtype([("node", "<i8"), ("n", "<i8")])


def hot_nodes(source: DataFrame, make: Maker, parts: int) -> np.ndarray:
    """The nodes with ``HOT`` entries or more, sorted."""

    def count(batches):
        for batch in batches:
            node, n = np.unique(make(batch)["node"], return_counts=True)
            records = np.empty(len(node), _COUNT)
            records["node"], records["n"] = node, n
            yield _packed(records, parts, "counts")

    def add(batches):
        records = _joined(batches, _COUNT)
        records = records[np.argsort(records["node"], kind="stable")]
        starts, _ = _runs(records["node"])
        total = np.add.reduceat(records["n"], starts) if len(starts) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(records["node"][starts][total >= HOT]))], ["node"])

    counted = source.mapInArrow(count, "part int, counts binary").repartition(parts, "part").mapInArrow(add, "node long")
    return np.sort(np.array([r.node for r in counted.toLocalIterator()], np.int64))


def meet(source: DataFrame, make: Maker, entries: int) -> DataFrame:
    """(node, member, size, first) for every entry of a node with two members or more.

    ``make`` turns a batch of ``source`` into entries, of which there are at most
    ``entries`` in all. ``first`` is the smallest member of the node.
    """
    parts = max(16, -(-entries // PART_ENTRIES))
    # Fewer entries in all than ``HOT`` have no such node.
    found_hot = hot_nodes(source, make, parts) if entries >= HOT else np.zeros(0, np.int64)
    hot = source.sparkSession.sparkContext.broadcast(found_hot)

    def pack(batches):
        for batch in batches:
            found = unique(make(batch))
            yield _packed(found[~np.isin(found["node"], hot.value)], parts, "entries")

    def shared(batches):
        found = unique(_joined(batches, ENTRY))
        starts, sizes = _runs(found["node"])
        size, first = np.repeat(sizes, sizes), np.repeat(found["member"][starts], sizes)
        keep = size > 1
        yield pa.RecordBatch.from_arrays([
            *(pa.array(np.ascontiguousarray(found[c][keep])) for c in ("node", "member")),
            pa.array(size[keep].astype(np.int64)), pa.array(first[keep]),
        ], ["node", "member", "size", "first"])

    cold = source.mapInArrow(pack, "part int, entries binary").repartition(parts, "part").mapInArrow(shared, ROWS)
    if not len(hot.value):
        return cold

    def loose(batches):
        for batch in batches:
            found = unique(make(batch))
            found = found[np.isin(found["node"], hot.value)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[c])) for c in ("node", "member")], ["node", "member"])

    rows = source.mapInArrow(loose, "node long, member long")
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("member").alias("first"))
    # Few nodes, each with many rows: the sizes are broadcast if Spark sees that they are small, else a skewed join is split.
    return cold.unionByName(rows.join(sizes, "node").select("node", "member", "size", "first"))
