"""Byte-level BPE on sentencepiece: the model is written straight from a rank file.

Each byte stands for one printable character, so that any text is a string
sentencepiece can split into characters. The pieces are the vocabulary's byte
strings in that spelling, and the score of a piece is its negative rank: the
merge with the smallest rank goes first, the leftmost of equals, which is the
rule of rank files. Normalisation is the identity. Texts are cut into
pre-tokens, encoded one by one; ids are decoded by the inverse spelling.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The white space of \s in the tokenizer's pattern (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
GROUP_CHARS = 1 << 20  # of texts that are encoded at once
CACHE_ENTRIES = 300_000  # cut pieces of text remembered by a task

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def spelling() -> list[str]:
    """One printable character for each byte: itself where it prints, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in data.splitlines() if line)}


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, a whole number, or a 32-bit float."""

    def whole(n: int) -> bytes:
        n &= (1 << 64) - 1
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, bytes):
        return whole(number << 3 | 2) + whole(len(value)) + value
    if isinstance(value, float):
        return whole(number << 3 | 5) + struct.pack("<f", value)
    return whole(number << 3) + whole(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model; the piece of rank r has the id r + 1, and 0 is the unknown piece.

    The ranks must be 0, 1, 2, ... without a gap.
    """
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("the ranks have gaps or repeat")
    letters = spelling()
    # Field numbers and types of sentencepiece's model format.
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        name = "".join(letters[b] for b in piece).encode()
        out.append(_field(1, _field(1, name) + _field(2, -float(rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*out, _field(2, trainer), _field(3, normalizer)])


class Codec:
    """Encodes and decodes texts; keeps a bounded cache of pieces it has cut and encoded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_entries: int = CACHE_ENTRIES):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.ranks = ranks
        letters = spelling()
        self.letters = {b: c for b, c in enumerate(letters) if ord(c) != b}  # of bytes that do not stand for themselves
        self.back = {c: b for b, c in enumerate(letters)}
        # Decoding: the bytes of every id, by the inverse spelling of the model's pieces.
        self.bytes_of = [
            bytes(self.back[c] for c in self.model.id_to_piece(i + 1)) for i in range(self.model.get_piece_size() - 1)]
        # A single blank between two other characters always starts a pre-token, so texts are cut there first.
        self.cut = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
        self.odd = re.compile(f" [{SPACE}]|[{SPACE}] |^ | $")
        self.pre_tokens = regex.compile(pattern.replace(r"\S", f"[^{SPACE}]").replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]"))
        self.cache: dict[str, bytes] = {}
        self.cache_entries = cache_entries

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces that are new to the cache; a piece starts with its blank, if any."""
        plan, spelled, ranks, letters, cache = [], [], self.ranks, self.letters, self.cache
        blank = letters[32]
        for piece in pieces:
            # A pre-token stands as its id, or as None where its letters have to be merged.
            cuts = []
            for t in self.pre_tokens.findall(piece):
                cuts.append(whole := ranks.get(t.encode()))
                if whole is None:
                    plain = t.isascii() and t.isprintable()
                    spelled.append(t.replace(" ", blank) if plain else t.encode().decode("latin-1").translate(letters))
            plan.append(cuts)
        merged = iter(self._merged(spelled))
        for piece, cuts in zip(pieces, plan, strict=True):
            cache[piece] = b"".join([next(merged) if whole is None else whole.to_bytes(4, "little") for whole in cuts])

    def _merged(self, spelled: list[str]) -> list[bytes]:
        """The ids of each spelled pre-token; the model numbers them from 1."""
        if not spelled:
            return []
        found = self.model.encode(spelled, out_type=int, num_threads=1)
        flat = (np.fromiter(chain.from_iterable(found), np.int64) - 1).astype("<u4").tobytes()
        ends = [4 * n for n in accumulate(map(len, found))]
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self._encoded([text])[0]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text. Pieces of neighbouring texts are learnt together: a call of the model costs as much as some hundred of them."""
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > GROUP_CHARS:
                yield from self._encoded(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        yield from self._encoded(group)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        pieces, ends, ids, cache = [], [], [], self.cache
        for text in texts:
            parts = self.cut.split(text) if self.odd.search(text) else text.split(" ")
            pieces.append(parts[0])
            pieces += [" " + p for p in parts[1:]]
            ends.append(len(pieces))
        for i in range(0, len(pieces), 50_000):
            some = pieces[i : i + 50_000]
            needed = set(some)
            if new := needed.difference(cache):
                if len(cache) + len(new) > self.cache_entries:
                    cache.clear()
                    new = needed
                self._learn(new)
            ids += map(cache.__getitem__, some)
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``; with ``ids`` also the ids themselves.

    A NULL text counts as empty: no ids, and the digests of no bytes. A NULL
    doc_id stays NULL, repeated rows give repeated results, an empty table
    gives none. Other columns are not looked at. The rank file, under 1 MB, is
    read once by the driver and broadcast; texts of any length are encoded whole.
    """
    with open(ranks_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(read_ranks(ranks.value), pattern)
            counts, first, second, lists = [], [], [], []
            for out in codec.encode_all(text.as_py() or "" for text in batch.column(1)):
                counts.append(len(out) // 4)
                first.append(hashlib.sha256(out).hexdigest())
                second.append(hashlib.sha256(codec.decode(out)).hexdigest())
                if ids:
                    lists.append(np.frombuffer(out, "<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    slim = docs.selectExpr("cast(doc_id as bigint) as doc_id", f"`{text}` as text")
    return slim.mapInArrow(run, RESULT + (", ids array<int>" if ids else ""))
