"""Two tokenizers side by side: where their tokens end together, and which tokens meet there.

Texts are cut at single blanks between two other characters; neither
tokenizer joins across such a blank, so pieces are encoded once and remembered.
The byte places where tokens end are then merged in lockstep: one numpy vector
of states holds a pointer into either token list for every document of a batch
(a long document has several states, each for its own stretch of bytes), all
pointers advance at once, and documents that are through leave the vector. A
step emits a link, which is also a cut between groups, wherever both pointers
stand at tokens with the same end.

If two tokens end together, the bytes of one are a suffix of the other's. All
pairs that can ever meet are therefore known from the two vocabularies: their
number is at most the vocabularies' total length, which bounds the table of
counts that is broadcast.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from . import bpe, words

PIECE_BYTES = 1 << 20  # texts handled at once; longer texts are cut at blanks
LANE_BYTES = 256  # bytes of text per state of the merge
CACHE_ENTRIES = 400_000  # pieces of text remembered by a task
SHORT_RUN = 50  # pieces joined for B
LONG_PIECE = 1000  # longer pieces are encoded one by one
SIGN = "▁".encode()  # stands for a blank in B
MAX_PAIRS = 1 << 23  # a bound on the broadcast table: 64 MB

FIRST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def bytes_a(tokens: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary file (JSON)."""
    spec = json.loads(tokens)
    back = {c: b for b, c in enumerate(bpe.spelling())}
    names = {i: t for t, i in spec["model"]["vocab"].items()}
    for added in spec.get("added_tokens", ()):
        names.setdefault(added["id"], added["content"])
    return [bytes(back[c] for c in names[i]) if i in names and all(c in back for c in names[i]) else b"" for i in range(max(names) + 1)]


def bytes_b(model: bytes) -> list[bytes]:
    """The bytes of every id of a sentencepiece model; control pieces have none.

    The model must add a blank in front, keep blanks as they are, and hold no
    piece with a blank after another character.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = []
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i):
            out.append(b"")
        elif re.search("[^▁]▁", piece):
            raise ValueError("a piece runs over a blank")
        else:
            out.append(piece.replace("▁", " ").encode())
    if b"".join(out[i] for i in m.encode("x  x ")) != b" x  x ":
        raise ValueError("the model changes blanks")
    return out


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """a * len(b) + b of all ids whose tokens can end at the same byte: one is a suffix of the other. Sorted."""
    by_bytes: tuple[dict, dict] = ({}, {})
    for table, found in zip((a, b), by_bytes, strict=True):
        for i, token in enumerate(table):
            if token:
                found.setdefault(token, []).append(i)
    keys = set()
    for token, ids in by_bytes[0].items():
        for cut in range(len(token)):
            keys.update(i * len(b) + j for j in by_bytes[1].get(token[cut:], ()) for i in ids)
    for token, ids in by_bytes[1].items():
        for cut in range(1, len(token)):
            keys.update(i * len(b) + j for i in by_bytes[0].get(token[cut:], ()) for j in ids)
    if len(keys) > MAX_PAIRS:
        raise ValueError(f"the vocabularies allow {len(keys)} pairs, more than are broadcast")
    return np.sort(np.fromiter(keys, np.int64, len(keys)))


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ends_a`` and ``ends_b`` (both rising) of equal values, in order.

    ``edges`` are the ends of the stretches that are merged side by side.
    """
    upto_a, upto_b = np.searchsorted(ends_a, edges, side="right"), np.searchsorted(ends_b, edges, side="right")
    i, j = np.concatenate([[0], upto_a[:-1]]), np.concatenate([[0], upto_b[:-1]])
    live = (i < upto_a) & (j < upto_b)
    i, j, upto_a, upto_b = i[live], j[live], upto_a[live], upto_b[live]
    links_a, links_b = [], []
    while len(i):
        x, y = ends_a[i], ends_b[j]
        met = x == y
        links_a.append(i[met])
        links_b.append(j[met])
        i, j = i + (x <= y), j + (y <= x)
        live = (i < upto_a) & (j < upto_b)
        if not live.all():
            i, j, upto_a, upto_b = i[live], j[live], upto_a[live], upto_b[live]
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


def safe_blanks(texts: words.Texts) -> np.ndarray:
    """Places of single blanks at which a text may be cut: both neighbours are certainly no white space."""
    data = texts.data
    at = np.flatnonzero(data == 32)
    inner = np.ones(len(data) + 1, bool)
    inner[texts.bounds] = False  # first bytes
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[inner[at] & inner[at + 1]]
    before, after = data[at - 1], data[at + 1]
    # Wide white space ends with one of these bytes; after the lead bytes C3-DF there is none.
    odd = np.zeros(256, bool)
    odd[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
    lead = data[np.maximum(at - 2, 0)]
    good = ~words.BLANK[before] & (~odd[before] | (lead >= 0xC3) & (lead <= 0xDF) & (before >= 0x80))
    # Wide white space, and the sign that stands for a blank, start with one of these bytes.
    good &= ~words.BLANK[after] & ~np.isin(after, np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8))
    return at[good]


@dataclass
class Vocabularies:
    """What the driver reads once and sends to all tasks."""

    file_a: str
    model_b: bytes
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    pairs: np.ndarray
    pattern: str

    def ranked_a(self):
        """A in the library for ranks, which is faster: the same vocabulary, where a merge's rank is its result's id."""
        import tiktoken

        spec = json.loads(self.file_a)["model"]
        special = len(spec["vocab"]) - len(spec["merges"]) - 256
        ranks = {token: i for i, token in enumerate(self.bytes_a[: len(self.bytes_a) - special])}
        for rank, pair in enumerate(spec["merges"]):
            if spec["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))] != 256 + rank:
                raise ValueError("ids are not in the order of merges")
        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def read(cls, path_a: str, path_b: str, pattern: str) -> Vocabularies:
        with open(path_a, encoding="utf-8") as f:
            file_a = f.read()
        with open(path_b, "rb") as f:
            model_b = f.read()
        a, b = bytes_a(file_a), bytes_b(model_b)
        return cls(file_a, model_b, a, b, possible_pairs(a, b), pattern)


class Ragged:
    """Lists of numbers in one array."""

    def __init__(self):
        self.values, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.values = np.concatenate([self.values, values.astype(np.int32)])

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these lists in a row, and each list's size."""
        sizes = self.sizes[slots]
        shift = np.repeat(self.starts[slots] - (np.cumsum(sizes) - sizes), sizes)
        return self.values[shift + np.arange(len(shift))], sizes


def _texts(column: pa.Array) -> words.Texts:
    """All texts of a column at once."""
    return next((t for _, t in words.texts_of(column, 1 << 62, 1 << 62)), words.Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64)))


def _joined(texts: words.Texts) -> np.ndarray:
    """The bytes of all texts with a blank in front of each."""
    return np.insert(texts.data, texts.bounds[:-1], 32)


class Aligner:
    """Encodes pieces of text with both tokenizers and aligns the tokens."""

    def __init__(self, v: Vocabularies, cache_entries: int = CACHE_ENTRIES, lane_bytes: int = LANE_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(v.file_a)
        self.a.encode_special_tokens = True
        self.fast_a = v.ranked_a()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=v.model_b)
        self.v, self.cache_entries, self.lane_bytes = v, cache_entries, lane_bytes
        self.size_a = np.fromiter(map(len, v.bytes_a), np.int64, len(v.bytes_a))
        self.size_b = np.fromiter(map(len, v.bytes_b), np.int64, len(v.bytes_b))
        self.spelled_a, self.spelled_b = (pa.array(t, pa.large_binary()) for t in (v.bytes_a, v.bytes_b))
        # A token's number with the sign after it: inside a side, at the end of side A, at the end of a group.
        signs = ((len(v.bytes_a), ","), (len(v.bytes_a), "|"), (len(v.bytes_b), ","), (len(v.bytes_b), ";"))
        self.numbers = pa.array([f"{i}{sign}" for n, sign in signs for i in range(n)], pa.large_string())
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids_a, self.ids_b, self.good = Ragged(), Ragged(), np.zeros(0, bool)

    def _encode_one(self, piece: str) -> tuple[list[int], list[int]]:
        return self.a.encode(" " + piece, add_special_tokens=False).ids, self.b.encode(piece)

    def _encode_joined(self, texts: words.Texts) -> tuple | None:
        """Both tokenizers on all pieces as one text; None if that doesn't give back its bytes."""
        joined = _joined(texts)
        at = np.append((texts.bounds[:-1] + np.arange(len(texts)))[::SHORT_RUN], len(joined))
        whole = joined.tobytes()
        short = [whole[x + 1 : y].decode() for x, y in itertools.pairwise(at.tolist())]  # B is faster on short texts
        ids_b = np.fromiter(itertools.chain.from_iterable(self.b.encode(short, num_threads=1)), np.int64)
        sides = []
        for ids, size, spelled in (
            (self.fast_a.encode_to_numpy(whole.decode()), self.size_a, self.spelled_a), (ids_b, self.size_b, self.spelled_b)):
            if spelled.take(pa.array(ids)).buffers()[2].to_pybytes()[: int(size[ids].sum())] != whole:
                return None
            ends = np.searchsorted(np.cumsum(size[ids]), texts.bounds[1:] + np.arange(1, len(texts) + 1), side="right")
            sides.append((ids, np.diff(ends, prepend=0)))
        return sides

    def _learn(self, new: pa.Array) -> None:
        """Encode new pieces: joined by blanks if they may be, the others one by one."""
        texts = _texts(new)
        starts, ends = texts.bounds[:-1], texts.bounds[1:]
        # Between two letters every joining blank is one at which texts may be cut again.
        at = starts + np.arange(len(starts))
        open_ = np.isin(at, safe_blanks(words.Texts(np.append(_joined(texts), 97), np.array([0, len(texts.data) + len(texts) + 1]))))
        plain = np.append(open_[1:], False) & open_ & (ends - starts < LONG_PIECE)
        signs = np.flatnonzero(texts.data == SIGN[0])
        signs = signs[signs < len(texts.data) - 2]
        signs = signs[(texts.data[signs + 1] == SIGN[1]) & (texts.data[signs + 2] == SIGN[2])]
        plain[texts.owner(signs)] = False
        sides = self._encode_joined(_texts(new.filter(pa.array(plain)))) if plain.any() else [(np.zeros(0, np.int64),) * 2] * 2
        if sides is None:
            plain[:] = False
            sides = [(np.zeros(0, np.int64),) * 2] * 2
        odd = np.flatnonzero(~plain)
        alone = [(s, *self._encode_one(s)) for s in new.take(pa.array(odd)).to_pylist()]
        good = [b"".join([self.v.bytes_a[i] for i in x]) == b" " + s.encode() == b"".join([self.v.bytes_b[i] for i in y]) for s, x, y in alone]
        for side, (ids, sizes), kept in ((1, sides[0], self.ids_a), (2, sides[1], self.ids_b)):
            kept.extend(np.concatenate([ids, *[np.array(x[side], np.int64) for x in alone]]), np.concatenate([sizes, np.array([len(x[side]) for x in alone], np.int64)]))
        self.good = np.concatenate([self.good, np.ones(int(plain.sum()), bool), np.array(good, bool)])
        self.known = pa.concat_arrays([self.known, new.take(pa.array(np.concatenate([np.flatnonzero(plain), odd])))])

    def _slots_of(self, pieces: pa.Array) -> np.ndarray:
        coded = pieces.dictionary_encode()
        slots = pc.index_in(coded.dictionary, value_set=self.known)
        if slots.null_count:
            if len(self.known) + slots.null_count > self.cache_entries:
                self._forget()
                self._learn(coded.dictionary)
            else:
                self._learn(coded.dictionary.filter(slots.is_null()))
            slots = pc.index_in(coded.dictionary, value_set=self.known)
        return slots.to_numpy().astype(np.int64)[coded.indices.to_numpy()]

    def align(self, texts: words.Texts) -> list[tuple | None]:
        """For each text: tokens A, tokens B, links, the groups' text, pair codes and how often each; None without tokens."""
        cuts = safe_blanks(texts)
        some = np.flatnonzero(np.diff(texts.bounds) > 0)  # texts with a byte
        if not len(some):
            return [None] * len(texts)
        kept = np.ones(len(texts.data), bool)
        kept[cuts] = False
        starts = np.sort(np.concatenate([texts.bounds[some], cuts + 1]))
        ends = np.concatenate([np.cumsum(kept)[starts[1:] - 1], [kept.sum()]])
        pieces = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(texts.data[kept]))
        slots, owner = self._slots_of(pieces), texts.owner(starts)

        right = np.ones(len(texts), bool)
        right[owner[~self.good[slots]]] = False
        slots, owner = slots[right[owner]], owner[right[owner]]
        ids_a, in_a = self.ids_a.take(slots)
        ids_b, in_b = self.ids_b.take(slots)
        n_a, n_b = (np.bincount(owner, n, len(texts)).astype(np.int64) for n in (in_a, in_b))
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])

        upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
        text_ends = ends_a[upto_a[n_a > 0] - 1]  # every text's last byte is an edge, and every so many bytes another
        edges = np.union1d(text_ends, np.arange(self.lane_bytes, text_ends[-1], self.lane_bytes)) if len(text_ends) else text_ends
        link_a, link_b = merge_ends(ends_a, ends_b, edges)
        n_links = np.diff(np.searchsorted(link_a, upto_a, side="left"), prepend=0)

        spelled, text_at = self._groups(ids_a, ids_b, link_a, link_b, upto_a + upto_b)
        codes, times, code_at = self._pairs(ids_a[link_a], ids_b[link_b], np.repeat(np.arange(len(texts)), n_links), len(texts))
        out: list[tuple | None] = []
        for t in range(len(texts)):
            if n_a[t]:
                pair = slice(code_at[t], code_at[t + 1])
                out.append((int(n_a[t]), int(n_b[t]), int(n_links[t]), spelled[text_at[t] : text_at[t + 1] - 1], codes[pair], times[pair]))
            else:
                out.append(None)
        return out

    def _groups(self, ids_a, ids_b, link_a, link_b, upto) -> tuple[memoryview, np.ndarray]:
        """All groups as text, with the place where each document's text ends."""
        group_a, group_b = np.searchsorted(link_a, np.arange(len(ids_a))), np.searchsorted(link_b, np.arange(len(ids_b)))
        # In the text, a group's A tokens come before its B tokens.
        place_a = np.arange(len(ids_a)) + np.concatenate([[0], link_b + 1])[group_a]
        place_b = np.arange(len(ids_b)) + link_a[group_b] + 1
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        base = len(self.v.bytes_a)
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[link_a], last_b[link_b] = True, True
        order[place_a] = ids_a + base * last_a
        order[place_b] = ids_b + 2 * base + len(self.v.bytes_b) * last_b
        text = self.numbers.take(pa.array(order))
        at = np.frombuffer(text.buffers()[1], np.int64)[: len(order) + 1]
        return memoryview(text.buffers()[2] or b""), np.concatenate([[0], at[upto]])

    def _pairs(self, a, b, owner, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each document by their place in the table of pairs, and how often each occurs."""
        width = len(self.v.bytes_a) * len(self.v.bytes_b)
        keys = np.sort(owner * width + a.astype(np.int64) * len(self.v.bytes_b) + b)
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.diff(first, append=len(keys)).astype(np.int32)
        owner, key = np.divmod(keys[first], width)
        return np.searchsorted(self.v.pairs, key).astype(np.int32), times, np.searchsorted(owner, np.arange(n + 1))


def _stretches(texts: words.Texts, size: int) -> Iterator[words.Texts]:
    """A long text in parts of about this many bytes, cut at safe blanks, which are left out."""
    cuts = safe_blanks(texts)
    at, end = 0, len(texts.data)
    while at < end:
        place = np.searchsorted(cuts, at + size)
        to = int(cuts[place]) if place < len(cuts) else end
        yield words.Texts(texts.data[at:to], np.array([0, to - at]))
        at = to + 1


def align_batch(aligner: Aligner, column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple]:
    """n_a, n_b, n_links, digest, codes, times for every text of a column, in order."""
    none = np.zeros(0, np.int32)
    for _, texts in words.texts_of(column, size):
        if len(texts) == 1 and len(texts.data) > 2 * size:
            parts = [p for part in _stretches(texts, size) for p in aligner.align(part)]
            if any(p is None for p in parts):
                yield 0, 0, 0, "", none, none
                continue
            digest = hashlib.sha256(b";".join(p[3] for p in parts)).hexdigest()
            codes, place = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True)
            times = np.bincount(place, np.concatenate([p[5] for p in parts])).astype(np.int32)
            yield *(sum(p[i] for p in parts) for i in range(3)), digest, codes, times
            continue
        for found in aligner.align(texts):
            if found is None:
                yield 0, 0, 0, "", none, none
            else:
                n_a, n_b, n_links, text, codes, times = found
                yield n_a, n_b, n_links, hashlib.sha256(text).hexdigest(), codes, times


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.fromiter(map(len, parts), np.int32, len(parts))
    values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def alignments(docs: DataFrame, v: Vocabularies, text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the pairs met (codes: places in ``v.pairs``; times)."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(shared.value)
            n_a, n_b, n_links, digests, codes, times = zip(*align_batch(aligner, batch.column(1)), strict=True) if len(batch) else [()] * 6
            links = pa.array(n_links, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), links, links, pa.array(digests, pa.string()),
                 _list_array(codes), _list_array(times)],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", f"`{text}` as text").mapInArrow(run, FIRST)


def pair_counts(found: DataFrame, v: Vocabularies) -> np.ndarray:
    """How many links hold each pair of ``v.pairs``, over all documents."""
    counted = found.select(F.inline(F.arrays_zip("codes", "times"))).groupBy("codes").agg(F.sum("times").alias("n")).toArrow()
    out = np.zeros(len(v.pairs), np.int64)
    out[counted.column("codes").to_numpy()] = counted.column("n").to_numpy()
    return out


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``.

    A is a byte-level BPE file (JSON) with its pattern that gets a blank in front
    of each text, B a sentencepiece BPE model that adds one. Documents without text, and those
    whose token bytes aren't a blank and the text (as when the text holds the
    sign that B takes for a blank), have no tokens: zeros and ''. A NULL doc_id
    stays NULL, repeated rows give repeated results and count repeatedly, an
    empty table gives none; other columns are not looked at. Texts of any length
    are aligned whole. Every row is decided on its own but for the counts of
    pairs, which are as many numbers as the vocabularies allow pairs.
    """
    v = Vocabularies.read(path_a, path_b, pattern)
    found = saved(alignments(docs, v, text))
    counts = pair_counts(found, v)
    b_of = v.pairs % len(v.bytes_b)
    best = np.zeros(len(v.bytes_b), np.int64)
    np.maximum.at(best, b_of, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == best[b_of]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, is_best = shared.value
        for batch in batches:
            codes, times = batch.column("codes"), batch.column("times")
            at = np.asarray(codes.offsets)
            code, n = np.asarray(codes.values)[at[0] : at[-1]], np.asarray(times.flatten()).astype(np.int64)
            at = at.astype(np.int64) - at[0]
            totals = [np.concatenate([[0], np.cumsum(x)]) for x in (n * is_best[code], n * counts[code])]
            more = [pa.array(t[at[1:]] - t[at[:-1]], pa.int64()) for t in totals]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more, batch.column("groups_sha256")], [f.split()[0] for f in RESULT.split(", ")])

    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times").mapInArrow(run, RESULT)
