"""Near-duplicate lines by an exact set-similarity join; later matches are removed.

The tokens of a line are its distinct five-word shingles (A-Z as a-z); a line of
fewer words has all of them as its one token, and lines without words take no
part. Two lines match at a Jaccard similarity of 0.75 or more, and a line goes if
any earlier line matches it, by doc_id and place.

Tokens are put in order of rarity. Two matching lines share a token among the
first n - ceil(0.75 n) + 1 of a line's n tokens (its prefix). Sets that are
equal count once, with their earliest line. They meet in a node for each token of
their prefix; most tokens are in one set only and are dropped where they meet.
Sets of one or two tokens match equal sets only, and enter no node.

1. In each node the sets are compared with its earliest one, which decides most
   members of large groups.
2. Those left over are compared with every earlier set of their nodes; a large
   node is cut into blocks for that.

The sets of a node meet in one task, unless its token may be in ``HOT`` lines or
more. Such a node is dealt out by set, and goes by way of Spark's own joins.

Before a pair is verified on its whole sets, its sizes and the tokens that can
follow the shared one have to allow a match. Rarity comes from counts of all
tokens in 2 ** 20 buckets, a table of fixed size; any fixed order gives the same
matches, and rare tokens first make nodes small. Tokens are 52 bits of a hash,
sets are known by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved
from . import words

WORDS = 5
BUCKET_BITS = 20
CHUNK = 4096  # buckets in one row of the table on its way
TINY = 16  # sets of a node that are tried with each other as soon as they meet
ALONE = 2  # tokens; sets of so many match no other set
BLOCK = 1024  # sets of a node that are compared at once
PART_LINES = 50_000  # lines whose prefixes meet in one task
HOT = 1 << 21  # times that the tokens of a bucket are there; seen by its code of rarity, so nodes with as many entries or more are hot, and some with fewer
BROADCAST_ROWS = 1_000_000  # hashes of rows, of 8 bytes; beyond that the texts are shuffled to them
FILTER_BITS = 24

_LINE_BLOCK = 4096
_FULL = 65535  # sizes and places from here on are not known exactly, and allow any match
_ENTRY = np.dtype([("node", "<u8"), ("h", "<i8"), ("n", "<u2"), ("pos", "<u2")])


def _needed(n):
    """ceil(0.75 n): the tokens that a match shares at least with a line of n tokens."""
    return (3 * n + 3) // 4


def _line_tokens(texts: words.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every line; line and hash of every shingle, or of all words of a shorter line, in the order of lines."""
    lowered = texts.lowered()
    first, _ = lowered.lines()
    starts, ends = lowered.words()
    line = np.searchsorted(first, starts, side="right") - 1
    last = len(line) - WORDS + 1
    at = np.flatnonzero(line[:last] == line[WORDS - 1 :]) if last > 0 else np.zeros(0, np.int64)
    hashes = lowered.hashes(starts, ends)
    counts = np.bincount(line, minlength=len(first))
    begin = np.cumsum(counts) - counts
    lines, values = [line[at]], [words.grams(hashes, WORDS, at)]
    for short in range(1, WORDS):
        some = np.flatnonzero(counts == short)
        lines.append(some)
        values.append(words.grams(hashes, short, begin[some]))
    lines, values = np.concatenate(lines), np.concatenate(values)
    order = np.argsort(lines, kind="stable")
    return first, lines[order], values[order]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the counts by chunk; the table's size bounds what is held."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for first, counts in zip(batch.column(0).to_pylist(), words.matrix_of(batch.column(1), np.int64, CHUNK), strict=True):
            sums[first] = sums[first] + counts if first in sums else counts.copy()
    rows = np.stack(list(sums.values())) if sums else np.zeros((0, CHUNK), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), words.binary_rows(rows)], ["first", "counts"])


def _code(counts) -> np.ndarray:
    return np.minimum(4 * np.log2(1.0 + counts), 255).astype(np.uint8)


def rarity(counts: DataFrame) -> np.ndarray:
    """By bucket, a code of 8 bits that grows with the count of its tokens; from the counts (first, counts) of all tasks."""
    added = counts.repartition(16, "first").mapInArrow(_add, "first int, counts binary")
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in added.collect():  # at most 2 ** 20 counts of 8 bytes
        total[r.first : r.first + CHUNK] = np.frombuffer(r.counts, np.int64)
    return _code(total)


class Lines:
    """The lines of some texts that have tokens: owner, number in the text, sorted tokens, and a hash of the set."""

    def __init__(self, texts: words.Texts):
        first, line, self.all_hashes = _line_tokens(texts)
        sets, sizes = [np.zeros(0, np.uint64)], []
        edges = np.searchsorted(line, np.arange(0, len(first) + _LINE_BLOCK, _LINE_BLOCK))
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            some = words.distinct((line[a:b] - i * _LINE_BLOCK).astype(np.uint64) << np.uint64(52) | self.all_hashes[a:b] >> np.uint64(12))
            sets.append(some & np.uint64((1 << 52) - 1))
            sizes.append(np.bincount((some >> np.uint64(52)).astype(np.int64), minlength=_LINE_BLOCK))
        sizes = np.concatenate(sizes)[: len(first)]
        keep = sizes > 0
        self.tokens, self.sizes = np.concatenate(sets), sizes[keep]
        self.cuts = np.concatenate([[0], np.cumsum(self.sizes)])
        # Lines are in the order of the texts: each text has one line more than line breaks.
        breaks = np.concatenate([[0], np.cumsum(texts.data == 10)])[texts.bounds]
        per_text = np.diff(breaks) + 1
        owner = np.repeat(np.arange(len(texts)), per_text)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        self.owner, self.number = owner[keep], number[keep].astype(np.int32)
        self.hash = words.sequence_hashes(self.tokens, self.cuts).view(np.int64)

    def entries(self, codes: np.ndarray, hot: int) -> np.ndarray:
        """One entry for each token of each set's prefix, the rarest tokens; none of sets that match equal ones only.

        The lowest bit of a node is set if the code of its token's bucket is ``hot`` or more; no node has more
        entries than its bucket has tokens.
        """
        _, some = np.unique(self.hash, return_index=True)
        some = some[self.sizes[some] > ALONE]
        n = self.sizes[some]
        line = np.repeat(np.arange(len(n)), n)
        tokens = self.tokens[self.cuts[some][line] + np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)]
        # In the order of line, rarity and token; line and rarity in one number.
        rank = codes[(tokens >> np.uint64(52 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64)
        ordered = []
        for i in range(0, len(n), _LINE_BLOCK):
            a, b = np.searchsorted(line, (i, i + _LINE_BLOCK))
            # 12 bits of line, 8 of rarity, 44 of the token: enough to order by, and to join on.
            ordered.append(np.sort(
                (line[a:b] - i).astype(np.uint64) << np.uint64(52) | rank[a:b] << np.uint64(44) | tokens[a:b] & np.uint64((1 << 44) - 1)))
        tokens = np.concatenate(ordered) & np.uint64((1 << 52) - 1) if ordered else tokens
        prefix = n - _needed(n) + 1
        row = np.repeat(np.arange(len(n)), prefix)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        out = np.empty(len(row), _ENTRY)
        token = tokens[(np.cumsum(n) - n)[row] + pos]
        out["node"] = words.mix(token + np.uint64(5)) & ~np.uint64(1) | (token >> np.uint64(44) >= np.uint64(hot)).astype(np.uint64)
        out["h"] = self.hash[some][row]
        out["n"], out["pos"] = np.minimum(n, _FULL)[row], np.minimum(pos, _FULL)
        return out


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text) -> (h, row, doc_id, line) of every line, and at the end (first, counts) of the tokens by bucket."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["h", "row", "doc_id", "line", "first", "counts"]
    for batch in batches:
        for row, texts in words.texts_of(batch.column(2)):
            lines = Lines(texts)
            total += np.bincount(_bucket(lines.all_hashes), minlength=len(total))
            at = pa.array(lines.owner + row)
            columns = [pa.array(lines.hash), *(batch.column(i).take(at) for i in (0, 1)), pa.array(lines.number)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(at), k) for k in kinds[4:])], names)
    some = [i for i in range(0, len(total), CHUNK) if total[i : i + CHUNK].any()]
    if some:
        counts = words.binary_rows(np.stack([total[i : i + CHUNK] for i in some]))
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), k) for k in kinds[:4]), pa.array(some, pa.int32()), counts], names)


def _unique(entries: np.ndarray) -> np.ndarray:
    """Entries sorted by node and set, each once."""
    entries = entries[np.lexsort((entries["h"], entries["node"]))]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["node"][1:] != entries["node"][:-1]) | (entries["h"][1:] != entries["h"][:-1])
    return entries[new]


def _is_hot(entries: np.ndarray) -> np.ndarray:
    return (entries["node"] & np.uint64(1)).astype(bool)


def _packed(codes, parts: int, hot: int):
    """(text) -> the entries of a batch, each once, packed by the part that their nodes go to; of hot nodes, by that of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Lines(texts).entries(codes.value, hot) for _, texts in words.texts_of(batch.column(0))]
            if not found:
                continue
            entries = _unique(np.concatenate(found))
            node, h = entries["node"] >> np.uint64(1), np.ascontiguousarray(entries["h"]).view(np.uint64)
            part = (np.where(_is_hot(entries), words.mix(node ^ h), node) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cuts))
            data = [entries[order[cuts[i] : cuts[i + 1]]].tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(data, pa.binary())], ["part", "entries"])

    return run


def _hopeful(entries: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Entries of nodes with several sets, without those of small nodes that can match no other entry there."""
    node, n, pos = entries["node"], entries["n"].astype(np.int64), entries["pos"].astype(np.int64)
    keep = size > TINY
    for shift in range(1, TINY):
        at = np.flatnonzero((size[shift:] <= TINY) & (node[shift:] == node[:-shift]))
        if not len(at):
            break
        at = at[_may_match(n[at], pos[at], n[at + shift], pos[at + shift], np.minimum, np.maximum)]
        keep[at] = keep[at + shift] = True
    return keep


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of nodes with two sets or more that may match another one, and the size of their node.

    Of hot nodes all the entries that come here, with the size 0.
    """
    found = [np.frombuffer(x.as_buffer(), _ENTRY) for batch in batches for x in batch.column(1)]
    entries = _unique(np.concatenate(found)) if found else np.zeros(0, _ENTRY)
    starts = np.flatnonzero(np.concatenate([[True], entries["node"][1:] != entries["node"][:-1]])) if len(entries) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(entries)))
    size = np.repeat(sizes, sizes)
    loose = _is_hot(entries)
    some = entries[loose]
    entries, size = entries[~loose & (size > 1)], size[~loose & (size > 1)]
    keep = _hopeful(entries, size)
    entries, size = np.concatenate([entries[keep], some]), np.concatenate([size[keep], np.zeros(len(some), size.dtype)])
    yield pa.RecordBatch.from_arrays([
        pa.array(np.ascontiguousarray(entries["node"]).view(np.int64)),
        pa.array(np.ascontiguousarray(entries["h"])), pa.array(entries["n"].astype(np.int32)), pa.array(entries["pos"].astype(np.int32)),
        pa.array(size.astype(np.int64)),
    ], ["node", "h", "n", "pos", "size"])


def _filter_bits(hashes: DataFrame) -> np.ndarray:
    """A bit for each of the hashes (h), by its lowest ``FILTER_BITS`` bits: 2 MB, however many hashes."""
    place = F.pmod("h", F.lit(1 << FILTER_BITS)) + 1
    maps = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in maps.collect():
        out[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def _whole_sets(bits):
    """(text) -> (h, tokens) of the sets whose bit is set; a set may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in words.texts_of(batch.column(0)):
                lines = Lines(texts)
                at = lines.hash & ((1 << FILTER_BITS) - 1)
                wanted = np.flatnonzero(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                keep = np.zeros(len(lines.hash), bool)
                keep[wanted[np.unique(lines.hash[wanted], return_index=True)[1]]] = True
                tokens = pa.array(lines.tokens[np.repeat(keep, lines.sizes)].view(np.int64))
                cuts = pa.array(np.concatenate([[0], np.cumsum(lines.sizes[keep])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(lines.hash[keep]), pa.ListArray.from_arrays(cuts, tokens)], ["h", "tokens"])

    return run


def _may_match(n1, p1, n2, p2, least=F.least, greatest=F.greatest):
    """By length and position: can two sets match that share a token at these places?"""
    small, large = least(n1, n2), greatest(n1, n2)
    left = least(n1 - p1, n2 - p2)
    return (large >= _FULL) | ((4 * small >= 3 * large) & (7 * left >= 3 * (n1 + n2)))


def _earlier_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, h, n, pos, open, alone) in the order of cell and line: pairs of an open row and an earlier one that may match.

    In a cell with ``alone`` the earlier one is not open: open rows meet each other elsewhere.
    """
    held = None

    def pairs(cell, h, n, pos, open_, alone):
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        place = np.arange(len(cell)) - np.repeat(starts, np.diff(np.append(starts, len(cell))))
        left, right = [h[:0]], [h[:0]]
        for shift in range(1, int(place.max(initial=0)) + 1):
            at = np.flatnonzero(open_ & (place >= shift))
            if not len(at):
                break
            at = at[(h[at] != h[at - shift]) & ~(alone[at] & open_[at - shift])]
            at = at[_may_match(n[at], pos[at], n[at - shift], pos[at - shift], np.minimum, np.maximum)]
            left.append(h[at - shift])
            right.append(h[at])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
        held = [c[cut:] for c in columns]
        yield pairs(*(c[:cut] for c in columns))
    if held is not None:
        yield pairs(*held)


def _cells(rows: DataFrame) -> DataFrame:
    """(cell, first, h, n, pos, open, alone) of rows (node, h, n, pos, size, first, open, opens): every open row meets every row of its node.

    A node of up to ``BLOCK`` rows is one cell. In larger ones every two blocks of open rows are a cell, and every
    block of open rows with every block of others (``alone``), so the others are copied for each block of open rows only.
    """
    own = F.when(F.col("open"), F.col("open_blocks")).otherwise(F.col("known_blocks"))
    placed = (
        rows.withColumn("open_blocks", F.greatest(F.lit(1), F.ceil(F.col("opens") / BLOCK)).cast("int"))
        .withColumn("known_blocks", F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("opens")) / BLOCK)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("h"), own).cast("int"))
    )
    cell = lambda alone, *by: F.struct(F.xxhash64("node", F.lit(alone), *by).alias("cell"), F.lit(alone).alias("alone"))
    of_open = F.sequence(F.lit(0), F.col("open_blocks") - 1)
    among = F.transform(of_open, lambda i: cell(False, F.least("block", i), F.greatest("block", i)))
    to_known = F.transform(F.sequence(F.lit(0), F.col("known_blocks") - 1), lambda j: cell(True, F.col("block"), j))
    to_open = F.transform(of_open, lambda i: cell(True, i, F.col("block")))
    at = F.when(F.col("size") <= BLOCK, F.array(cell(False))).when(F.col("open"), F.concat(among, to_known)).otherwise(to_open)
    return placed.withColumn("at", F.explode(at)).select("at.cell", "first", "h", "n", "pos", "open", "at.alone")


class Join:
    """The join over the lines of ``docs`` (row, doc_id, text)."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        kind = "h long, row long, doc_id long, line int, first int, counts binary"
        found = saved(docs.select("row", "doc_id", "text").mapInArrow(_line_rows, kind))
        self.lines = found.where("h is not null").select("h", "row", "doc_id", "line")
        self.codes = docs.sparkSession.sparkContext.broadcast(rarity(found.where("first is not null").select("first", "counts")))  # 2 ** 20 bytes
        # The earliest line of each set.
        self.sets = saved(
            self.lines.groupBy("h").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"), F.count(F.lit(1)).alias("copies")))

    def shared(self) -> DataFrame:
        """Entries (node, h, n, pos, size, first) of nodes with two sets or more."""
        parts = max(16, -(-self.sets.count() // PART_LINES))
        hot = int(_code(HOT))
        packed = self.docs.select("text").mapInArrow(_packed(self.codes, parts, hot), "part int, entries binary")
        entries = packed.repartition(parts, "part").mapInArrow(_shared, "node long, h long, n int, pos int, size long")
        if not (self.codes.value >= hot).any():
            return saved(entries.join(self.sets.select("h", "first"), "h"))
        entries = saved(entries)
        loose = entries.where("size = 0").drop("size")
        sizes = saved(loose.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        entries = entries.where("size > 0").unionByName(loose.join(sizes, "node").select("node", "h", "n", "pos", "size"))
        return saved(entries.join(self.sets.select("h", "first"), "h"))

    def whole_sets(self, needed: DataFrame) -> DataFrame:
        """(h, tokens) of the sets ``needed`` (h), taken from the rows that have them first."""
        needed = saved(needed.distinct())
        rows = needed.join(self.sets.select("h", "first.row"), "h").select("row").distinct()
        some = F.broadcast(rows) if needed.count() <= BROADCAST_ROWS else rows
        texts = self.docs.join(some, "row", "left_semi").select("text")
        bits = self.docs.sparkSession.sparkContext.broadcast(_filter_bits(needed))
        found = texts.mapInArrow(_whole_sets(bits), "h long, tokens array<long>").join(needed, "h", "left_semi")
        return saved(found.dropDuplicates(["h"]))

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The later sets (h) of the pairs (a, b) that match."""
        met = (
            pairs.distinct().join(sets.selectExpr("h as a", "tokens as left"), "a").join(sets.selectExpr("h as b", "tokens as right"), "b")
            .select("b", F.size(F.array_intersect("left", "right")).alias("both"), (F.size("left") + F.size("right")).alias("sum"))
        )
        return saved(met.where("4L * both >= 3L * (sum - both)").select(F.col("b").alias("h")).distinct())

    def later_matches(self) -> DataFrame:
        """The sets (h) that match a set whose earliest line is earlier."""
        entries = self.shared()
        sets = self.whole_sets(entries.select("h"))
        # Tables of their own: with plain tables on both sides, Spark can split joins that are skewed.
        pivots = saved(entries.groupBy("node").agg(F.min(F.struct("first", "h", "n", "pos")).alias("p")))
        stars = entries.join(pivots, "node").where(F.col("h") != F.col("p.h")).where(
            _may_match(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos")))
        known = self.verify(stars.select(F.col("p.h").alias("a"), F.col("h").alias("b")), sets)
        left = entries.join(known.withColumn("known", F.lit(True)), "h", "left").withColumn("open", F.col("known").isNull())
        # Of the rows that are left, those with something earlier in their node; the pivots have nothing.
        opens = saved(
            left.where("open").join(pivots, "node").where(F.col("h") != F.col("p.h")).groupBy("node").agg(F.count(F.lit(1)).alias("opens")))
        cells = _cells(left.join(opens, "node")).repartition("cell").sortWithinPartitions("cell", "first", "h")
        kind = cells.select("cell", "h", "n", "pos", "open", "alone")
        rest = self.verify(kind.mapInArrow(_earlier_in_cells, "a long, b long"), sets)
        return known.unionByName(rest).distinct()

    def removed(self) -> DataFrame:
        """(row, doc_id, gone): the numbers of the lines to remove, for every row that has some."""
        bad = self.later_matches().withColumn("bad", F.lit(True))
        # A table of its own, so that Spark can split the lines that are very common.
        marked = saved(
            self.sets.join(bad, "h", "left").where("copies > 1 or bad").select("h", "first", F.coalesce("bad", F.lit(False)).alias("bad")))
        place = F.struct("doc_id", "row", "line")
        gone = self.lines.join(marked, "h").where(F.col("bad") | ~place.eqNullSafe(F.col("first")))
        return gone.groupBy("row", "doc_id").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    r"""The columns of ``docs`` (doc_id, text, ...) with a cleaned text, and n_lines, n_removed and removed_lines.

    Lines are \n-split and numbered from 0; n_lines counts all of them. Lines
    come in the order of doc_id (NULL first), rows with the same doc_id in the
    order of a hash of their text. Rows that are equal in doc_id and text are
    one row here and get the same result. NULL texts stay NULL and empty texts
    empty, with no lines to remove; a document may lose all its lines and is
    returned with an empty text. Columns of ``docs`` that are called like the
    new ones are replaced; any other name is free. Texts are read whole. An
    empty table gives an empty result.
    """
    slim = docs.select(_row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with words.small_batches(docs.sparkSession):
        gone = saved(Join(slim).removed())
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed_lines")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), _row_key().alias("row"), F.col("doc_id").cast("long").alias("id"))
    met = packed.join(gone, (packed["row"] == gone["row"]) & packed["id"].eqNullSafe(gone["doc_id"]), "left").select("doc", "gone")
    split = F.split(F.col("doc.text"), "\n", -1)
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(kept)
    return met.select(
        *[text.alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in names],
        F.coalesce(F.size(F.when(F.col("doc.text").isNotNull(), split)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"),
    )
