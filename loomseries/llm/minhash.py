"""Near duplicates by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles. Documents with the
same words are one class from the start. Each class has 64 minwise tokens: of
64 hash functions, the smallest value over its shingles. The join grows trees
over the classes. A node chooses by its own hash which functions to branch on,
and a class goes down to the child of its minwise token. Two sets with the
similarity J share a token with the probability J, so similar sets stay
together on some path and others part soon.

- In each node of the first level every class is compared with the smallest id of
  the node. Classes linked that way need no more pairs among themselves, and a
  node whose classes are all in one component is done.
- Other nodes of at most ``SMALL`` classes are compared exhaustively, and are
  leaves; larger ones branch further.
- Nodes that are still large at the last level, and have members in common, are
  a family. Its members are compared on their whole sets, by an exact join: two
  sets that are linked share one of their rarest shingles (their prefixes), and
  those that share one have to allow a link by their sizes, by the places of the
  shingle and by signatures. Prefixes that meet in large numbers are cut into
  blocks, so no task holds an unbounded node.

Pairs are first judged by sizes and by agreement of the 64 tokens, at a bound
that a pair at the threshold misses with a probability of about 1e-7; then every
link is confirmed on the full shingle sets. Independent trees are repeated
until a pair at the threshold is missed with a probability below 1e-6 in the
nodes of the first levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved
from . import linededup, nodes, words
from .components import components

WORDS = 5
THRESHOLD = 75  # per cent
FUNCTIONS = 64
AGREE = 28  # of 64 tokens; at a similarity of 0.75 no more agree with a probability of 1e-7
TREES = 12
SMALL = 32
LEVELS = 3
BLOCK = 1024  # prefixes in a node of a family that are compared at once
PIECE = 1 << 16  # rows of cells, and pairs, that are held at once
BITS = 2048  # of a signature
BROADCAST_IDS = 1_000_000  # ids of 8 bytes; beyond that the texts are shuffled to the ids

_FIXED = np.random.default_rng(20240611)
_FLIP = _FIXED.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint64).astype(np.uint32)
_TIMES = _FIXED.integers(0, 1 << 31, FUNCTIONS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)

# The marks of a class are the lowest bytes of its tokens, eight in a long.
PROFILE = "doc_id long, n_shingles long, c1 long, c2 long, tokens binary, marks array<long>"


def shingles(texts: words.Texts, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and 52-bit hash of every shingle in the order of the texts, and two hashes of each text's words."""
    lowered = texts.lowered()
    starts, ends = lowered.words()
    hashes = lowered.hashes(starts, ends)
    cuts = np.searchsorted(starts, texts.bounds)
    counts = np.diff(cuts)
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, np.int64)
    owners, values = [owner[at]], [words.grams(hashes, n, at)]
    for short in range(1, n):
        some = np.flatnonzero(counts == short)
        owners.append(some)
        values.append(words.grams(hashes, short, cuts[some]))
    owners, values = np.concatenate(owners), np.concatenate(values) >> np.uint64(12)
    if (counts[counts > 0] < n).any():
        order = np.argsort(owners, kind="stable")
        owners, values = owners[order], values[order]
    both = np.stack([words.sequence_hashes(hashes, cuts), words.sequence_hashes(words.mix(hashes), cuts)])
    return owners, values, both


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in words.texts_of(batch.column(1)):
            owner, values, both = shingles(texts)
            n = len(texts)
            distinct = words.distinct((owner.astype(np.uint64) << np.uint64(52)) | values)
            sizes = np.bincount((distinct >> np.uint64(52)).astype(np.int64), minlength=n)
            least = np.zeros((n, FUNCTIONS), np.uint32)
            some = np.flatnonzero(sizes)
            if len(some):
                first = np.searchsorted(owner, some)
                base = (values >> np.uint64(20)).astype(np.uint32)
                for k in range(FUNCTIONS):
                    drawn = (base ^ _FLIP[k]) * _TIMES[k]
                    drawn ^= drawn >> np.uint32(15)
                    least[some, k] = np.minimum.reduceat(drawn, first)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(row, n), pa.array(sizes, pa.int64()), pa.array(both[0].view(np.int64)),
                pa.array(both[1].view(np.int64)), words.binary_rows(least),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * (FUNCTIONS // 8)), pa.array(least.astype(np.uint8).view(np.int64).ravel())),
            ], ["doc_id", "n_shingles", "c1", "c2", "tokens", "marks"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in words.texts_of(batch.column(1)):
            owner, values, _ = shingles(texts)
            distinct = words.distinct((owner.astype(np.uint64) << np.uint64(52)) | values)
            sizes = np.bincount((distinct >> np.uint64(52)).astype(np.int64), minlength=len(texts))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            members = pa.array((distinct & np.uint64((1 << 52) - 1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), members)], ["id", "members"])


def _child(node: np.ndarray, place: np.ndarray, token: np.ndarray) -> np.ndarray:
    return words.mix(words.mix(node + place.astype(np.uint64)) ^ token.astype(np.uint64))


def _entries(node: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.empty(len(node), nodes.ENTRY)
    out["node"], out["member"] = node.view(np.int64), ids
    return out


def _roots(batch: pa.RecordBatch) -> np.ndarray:
    """First level, from (id, tokens): each tree branches on two functions of its own."""
    tokens = words.matrix_of(batch.column(1), np.uint32, FUNCTIONS)
    n, width = len(tokens), 2 * TREES
    place = np.tile(np.arange(width), n)
    tree = words.mix((place // 2).astype(np.uint64) + np.uint64(1))
    return _entries(_child(tree, place, tokens[:, :width].reshape(-1)), np.repeat(batch.column(0).to_numpy(), width))


def _branches(batch: pa.RecordBatch) -> np.ndarray:
    """Below, from (id, tokens, node): a node branches on one function, every third on two; its hash chooses."""
    ids = batch.column(0).to_numpy()
    tokens = words.matrix_of(batch.column(1), np.uint32, FUNCTIONS)
    node = batch.column(2).to_numpy().view(np.uint64)
    draw = words.mix(node + np.uint64(77))
    first = (draw % np.uint64(FUNCTIONS)).astype(np.int64)
    second = (first + 1 + (draw >> np.uint64(32)).astype(np.int64) % (FUNCTIONS - 1)) % FUNCTIONS
    two = np.flatnonzero((draw >> np.uint64(8)) % np.uint64(3) == 0)
    rows = np.concatenate([np.arange(len(node)), two])
    place = np.concatenate([first, second[two]])
    return _entries(_child(node[rows], place, tokens[rows, place]), ids[rows])


def _alike(na: np.ndarray, nb: np.ndarray, ma: np.ndarray, mb: np.ndarray) -> np.ndarray:
    """May the pairs be links, by their sizes and the agreement of their tokens?"""
    fits = 100 * np.minimum(na, nb) >= THRESHOLD * np.maximum(na, nb)
    some = np.flatnonzero(fits)
    fits[some] = (ma[some] == mb[some]).sum(axis=1) > AGREE
    return fits


def _equal_bytes(a: Column, b: Column) -> Column:
    """In how many of their bytes are two longs equal?"""
    x = a.bitwiseXOR(b)
    for n in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, n))
    # The lowest bit of a byte is now set if any of its bits was.
    return 8 - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def _may_be_alike(n1: Column, n2: Column, m1: Column, m2: Column) -> Column:
    """The same test on columns."""
    agree = reduce(add, [_equal_bytes(m1[i], m2[i]) for i in range(FUNCTIONS // 8)])
    return (100 * F.least(n1, n2) >= THRESHOLD * F.greatest(n1, n2)) & (agree > AGREE)


def _pairs_in_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, id, n, part, marks) sorted by node: pairs of one node that may be links and are in two parts."""

    def pairs(node, ids, n, part, marks):
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(node)), bool), node[1:] != node[:-1]]))
        place = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
        left, right = [ids[:0]], [ids[:0]]
        for shift in range(1, int(place.max(initial=0)) + 1):
            some = np.flatnonzero(place >= shift)
            some = some[part[some] != part[some - shift]]
            for at in np.array_split(some, max(1, len(some) // 50_000)):
                at = at[_alike(n[at], n[at - shift], marks[at], marks[at - shift])]
                left.append(ids[at - shift])
                right.append(ids[at])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held = None  # rows of the last node of the batch before, which may go on
    for batch in batches:
        columns = [*(batch.column(i).to_numpy() for i in range(4)), batch.column(4).flatten().to_numpy().view(np.uint8).reshape(-1, FUNCTIONS)]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
        held = [c[cut:] for c in columns]
        yield pairs(*(c[:cut] for c in columns))
    if held is not None:
        yield pairs(*held)


def _flat(members: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set; owner and value of each shingle."""
    n = members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return n, np.repeat(np.arange(len(n)), n), members.flatten().to_numpy()


def _bucket(values: np.ndarray) -> np.ndarray:
    return values >> (52 - linededup.BUCKET_BITS)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(members) -> (first, counts): the number of shingles by bucket."""
    total = np.zeros(1 << linededup.BUCKET_BITS, np.int64)
    for batch in batches:
        total += np.bincount(_bucket(_flat(batch.column(0))[2]), minlength=len(total))
    counts = total.reshape(-1, linededup.CHUNK)
    some = np.flatnonzero(counts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array((some * linededup.CHUNK).astype(np.int32)), words.binary_rows(counts[some])], ["first", "counts"])


def _prefixes(codes):
    """(id, members) -> (id, token, n, pos): the shingles of each prefix, and their places in the order of rarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, owner, value = _flat(batch.column(1))
            order = np.lexsort((value, codes.value[_bucket(value)], owner))
            # A link shares at least ceil(0.75 n) shingles, so one of the others or the first of these.
            prefix = np.minimum(n, n + THRESHOLD * -n // 100 + 1)
            row = np.repeat(np.arange(len(n)), prefix)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            token = value[order[(np.cumsum(n) - n)[row] + pos]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(token), pa.array(n[row]), pa.array(pos)], ["id", "token", "n", "pos"])

    return run


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, members) -> (id, n, bits): each bit tells if the number of shingles that fall on it is odd."""
    for batch in batches:
        n, owner, value = _flat(batch.column(1))
        odd = np.bincount(owner * BITS + value % BITS, minlength=len(n) * BITS) & 1
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * (BITS // 64))
        bits = pa.ListArray.from_arrays(offsets, pa.array(np.packbits(odd.astype(bool)).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), bits], ["id", "n", "bits"])


def _may_be_linked(n1: Column, n2: Column, s1: Column, s2: Column) -> Column:
    """May two sets be linked? At least as many shingles are in one of them only as there are bits that differ."""
    differ = reduce(add, [F.bit_count(s1[i].bitwiseXOR(s2[i])) for i in range(BITS // 64)])
    return (100 + THRESHOLD) * differ <= (100 - THRESHOLD) * (n1 + n2)


def _pairs_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, id, n, pos, part, rest, alone) in the order of cell and n: pairs of different parts that may be links.

    In a cell with ``alone``, rows of the rest meet others only.
    """

    def pairs(cell, ids, n, pos, part, rest, alone):
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1]]))
        place = np.arange(len(cell)) - np.repeat(starts, np.diff(np.append(starts, len(cell))))
        left, right, count, shift, at = [], [], 0, 0, np.arange(len(cell))
        while len(at):
            shift += 1
            at = at[place[at] >= shift]
            at = at[100 * n[at - shift] >= THRESHOLD * n[at]]  # sizes fall from here on
            to = at - shift
            some = (part[at] != part[to]) & ~(alone[at] & rest[at] & rest[to])
            some &= (100 + THRESHOLD) * np.minimum(n[at] - pos[at], n[to] - pos[to]) >= THRESHOLD * (n[at] + n[to])
            left.append(ids[to[some]])
            right.append(ids[at[some]])
            count += len(left[-1])
            if count >= PIECE or not len(at):
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                left, right, count = [], [], 0

    held, count = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        count += batch.num_rows
        if count >= PIECE:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last cell may go on
            held, count = [[c[cut:] for c in columns]], count - cut
            yield from pairs(*(c[:cut] for c in columns))
    if held:
        yield from pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))


class Join:
    """The join over ``classes`` (id, n, tokens, marks), with the texts of ``docs`` (doc_id, text) to confirm links."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes = docs, classes
        self.parts = None

    def with_parts(self, rows: DataFrame) -> DataFrame:
        """Add ``part``: the component of ``id`` as far as it is known."""
        if self.parts is None:
            return rows.withColumn("part", F.col("id"))
        return rows.join(self.parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")

    def link(self, links: DataFrame) -> None:
        """Bring the components up to date with confirmed links (a, b)."""
        if self.parts is not None:
            links = links.unionByName(self.parts.selectExpr("id as a", "component as b"))
        self.parts = saved(components(links))

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, members) of the whole sets of some ids."""
        needed = saved(ids.distinct())
        some = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
        texts = self.docs.join(some, self.docs.doc_id == needed.id, "left_semi").select("doc_id", "text")
        return saved(texts.mapInArrow(_sets, "id long, members array<long>"))

    def confirmed(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar; their ``sets`` (id, members) may be known."""
        pairs = saved(pairs.where("a <> b").distinct())
        if sets is None:
            sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        met = (
            pairs.join(sets.selectExpr("id as b", "members as right"), "b")
            .join(sets.selectExpr("id as a", "members as left"), "a")
            .select("a", "b", F.size(F.array_intersect("left", "right")).alias("both"), (F.size("left") + F.size("right")).alias("sum"))
        )
        return met.where(f"100L * both >= {THRESHOLD}L * (sum - both)").select("a", "b")

    def stars(self, rows: DataFrame) -> DataFrame:
        """The pairs (a, b) of each row (id, pivot) that may be links."""
        known = self.classes.select("id", "n", "marks")
        pairs = (
            rows.where("id <> pivot").select("id", "pivot").distinct()
            .join(known.selectExpr("id", "n as n1", "marks as m1"), "id")
            .join(known.selectExpr("id as pivot", "n as n2", "marks as m2"), "pivot")
        )
        return pairs.where(_may_be_alike(*(F.col(c) for c in ("n1", "n2", "m1", "m2")))).select(F.col("pivot").alias("a"), F.col("id").alias("b"))

    def inside(self, rows: DataFrame) -> DataFrame:
        """The pairs (a, b) of the same node in ``rows`` (node, id, part) that may be links; no node is large."""
        full = rows.join(self.classes.select("id", "n", "marks"), "id").select("node", "id", "n", "part", "marks")
        return full.repartition("node").sortWithinPartitions("node", "id").mapInArrow(_pairs_in_nodes, "a long, b long")

    def run(self, links: DataFrame) -> DataFrame:
        """(id, component) of all linked classes; some ``links`` (a, b) are known."""
        source, make, entries = self.classes.select("id", "tokens"), _roots, self.classes.count() * 2 * TREES
        small = []
        for level in range(LEVELS):
            rows = saved(nodes.meet(source, make, entries).select("node", F.col("member").alias("id"), "size", F.col("first").alias("pivot")))
            if level == 0:
                self.link(links.unionByName(self.confirmed(self.stars(rows))))
            # Nodes whose members are in two components or more go on.
            placed = self.with_parts(rows.select("node", "id", "size"))
            mixed = placed.groupBy("node").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
            going = saved(placed.join(mixed.select("node"), "node"))
            small.append(going.where(f"size <= {SMALL}").select("node", "id", "part"))
            large = going.where(f"size > {SMALL}")
            entries = large.count() * 2
            if not entries or level + 1 == LEVELS:
                break
            source = large.select("node", "id").join(self.classes.select("id", "tokens"), "id").select("id", "tokens", "node")
            make = _branches
        found = self.confirmed(self.inside(reduce(DataFrame.unionByName, small)))
        if entries:
            found = found.unionByName(self.in_families(large.select("node", "id")))
        self.link(found)
        return self.parts

    def in_families(self, rows: DataFrame) -> DataFrame:
        """The links (a, b) between members of nodes (node, id) that hang together, on their whole sets."""
        first = rows.groupBy("node").agg(F.min("id").alias("b"))
        family = components(rows.join(first, "node").select(F.col("id").alias("a"), "b").distinct())
        placed = saved(self.with_parts(family.withColumnRenamed("component", "family")))
        # The largest part of a family is compared with the rest of it, and the rest with itself.
        by_part = placed.groupBy("family", "part").agg(F.count(F.lit(1)).alias("n"))
        sizes = by_part.groupBy("family").agg(
            F.max_by("part", F.col("n")).alias("main"), F.max("n").alias("main_size"), F.sum("n").alias("size")).where("size > main_size")
        members = saved(placed.join(sizes, "family").select("id", "part", "family", (F.col("part") != F.col("main")).alias("rest")))
        sets = self.sets(members.select("id"))
        signs = saved(sets.mapInArrow(_signatures, "id long, n long, bits array<long>"))
        pairs = (
            self.in_prefixes(members, sets)
            .join(signs.selectExpr("id as a", "n as n1", "bits as s1"), "a").join(signs.selectExpr("id as b", "n as n2", "bits as s2"), "b")
            .where(_may_be_linked(*(F.col(c) for c in ("n1", "n2", "s1", "s2")))).select("a", "b")
        )
        return self.confirmed(pairs, sets)

    def in_prefixes(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) of ``members`` (id, part, family, rest) in one family and two parts whose prefixes allow a link."""
        counts = sets.select("members").mapInArrow(_bucket_counts, "first int, counts binary")
        codes = sets.sparkSession.sparkContext.broadcast(linededup.rarity(counts))  # 2 ** 20 bytes; any order gives the same links
        prefixes = sets.mapInArrow(_prefixes(codes), "id long, token long, n long, pos long")
        rows = saved(prefixes.join(members, "id").select(F.xxhash64("family", "token").alias("node"), "id", "n", "pos", "part", "rest"))
        # Nodes of one part need no pairs. Tables of their own, so that Spark can split a join that is skewed.
        sizes = saved(
            rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.count_if("rest").alias("rests"), F.min("part").alias("lo"), F.max("part").alias("hi"))
            .where("lo <> hi").drop("lo", "hi"))
        placed = (
            rows.join(sizes, "node")
            .withColumn("rest_blocks", F.ceil(F.col("rests") / BLOCK).cast("int"))
            .withColumn("main_blocks", F.ceil((F.col("size") - F.col("rests")) / BLOCK).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("rest_blocks")).otherwise(F.col("main_blocks"))).cast("int"))
        )
        # A node of up to ``BLOCK`` rows is one cell; in larger ones each two blocks of the rest, and one of it with one of the main part.
        cell = lambda alone, *by: F.struct(F.xxhash64("node", F.lit(alone), *by).alias("cell"), F.lit(alone).alias("alone"))
        of_rest = F.sequence(F.lit(0), F.col("rest_blocks") - 1)
        to_rest = F.transform(of_rest, lambda i: cell(False, F.least("block", i), F.greatest("block", i)))
        to_main = F.when(F.col("main_blocks") > 0, F.transform(
            F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda j: cell(True, F.col("block"), j))).otherwise(F.filter(to_rest, lambda _: F.lit(False)))
        from_main = F.transform(of_rest, lambda i: cell(True, i, F.col("block")))
        at = F.when(F.col("size") <= BLOCK, F.array(cell(False))).when(F.col("rest"), F.concat(to_rest, to_main)).otherwise(from_main)
        cells = placed.withColumn("at", F.explode(at)).select("at.cell", "id", "n", "pos", "part", "rest", "at.alone")
        sorted_cells = cells.repartition("cell").sortWithinPartitions("cell", "n", "id")
        return sorted_cells.mapInArrow(_pairs_in_cells, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    A-Z count as a-z, words are runs without ASCII blanks, and a document's set
    holds its distinct five-word shingles (fewer words: all of them as one).
    Documents whose sets have a similarity of 0.75 or more are linked;
    component_id is the smallest doc_id reachable, and the document that has it
    is kept. NULL and empty texts, and texts of blanks, have no shingles and
    stand alone. Rows that share a doc_id are one document, linked with
    whatever one of its texts is linked with. A row with a NULL doc_id takes no
    part: it has no component and is kept. Texts are read whole; other columns
    are not looked at. An empty table gives an empty result. Shingles are
    compared by 52-bit hashes.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = saved(slim.mapInArrow(_profile, PROFILE))
    full = profiles.where("n_shingles > 0 and doc_id is not null")
    classes = saved(
        full.groupBy("c1", "c2")
        .agg(F.min("doc_id").alias("id"), F.min_by(F.struct("n_shingles", "tokens", "marks"), "doc_id").alias("x"))
        .select("c1", "c2", "id", F.col("x.n_shingles").alias("n"), "x.tokens", "x.marks")
    )
    own = saved(
        profiles.select("doc_id", "n_shingles", "c1", "c2")
        .join(classes.select("c1", "c2", "id"), ["c1", "c2"], "left").select("doc_id", "n_shingles", "id"))
    # A doc_id with several texts links their classes.
    several = own.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("hi")).where("b < hi and doc_id is not null")
    links = own.join(several, "doc_id").select(F.col("id").alias("a"), "b")
    parts = Join(slim, classes).run(links)
    component = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "id"))
    return own.join(parts, "id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
