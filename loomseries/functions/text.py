"""Words, letters, patterns and ciphers over string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters; one ' or - may follow a letter. A - at the end of a word is not part of it.
WORD = "[A-Za-z]+(?:['-][A-Za-z]+)*['-]?"


def _clean(word: Column) -> Column:
    return F.rtrim(F.lower(word), F.lit("-"))


def words(text: Column) -> Column:
    """Lower-case words of a text, in order."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.transform(found, _clean)


def word_counts(df: DataFrame, text: str) -> DataFrame:
    found = df.select(F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("word"))
    return found.groupBy(_clean(F.col("word")).alias("word")).agg(F.count(F.lit(1)).alias("n"))


def word_count_of(text: Column) -> Column:
    """Number of runs of non-space; stands in for a tokenizer's count."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def letter_score(text: Column) -> Column:
    """Sum of A = 1 ... Z = 26 over the letters, either case; other characters count 0."""
    letters = F.split(F.regexp_replace(F.upper(text), "[^A-Z]", ""), "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x == "", 0).otherwise(F.ascii(x) - 64))


def partial_match(word: Column, pattern: str) -> Column:
    """``.`` stands for one character, anything else for itself."""
    parts = ["." if ch == "." else "\\x{%x}" % ord(ch) for ch in pattern]
    return word.rlike("^(?s:" + "".join(parts) + ")$")


def near_match(word: Column, target: str, distance: int) -> Column:
    """Words that differ from ``target`` in at most ``distance`` places, counted place by place.

    A place past the end of the word counts as many as are left of the target;
    past the end of the target every further character counts.
    """
    longest = F.greatest(F.length(word), F.lit(len(target)))
    differs = F.aggregate(
        F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), F.lit(0),
        lambda acc, i: acc + (F.substring(word, i, F.lit(1)) != F.substring(F.lit(target), i, F.lit(1))).cast("int"),
    )
    return differs <= distance


def quoted_names(text: Column) -> Column:
    """Contents of the double-quoted parts, in order."""
    return F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1))


def _shifted(text: Column, place) -> Column:
    """Replace each character 32..126 by its image under ``place`` on 0..94; others stay."""
    alphabet = "".join(chr(32 + i) for i in range(95))
    return F.translate(text, alphabet, "".join(chr(32 + place(i) % 95) for i in range(95)))


def affine_encrypt(text: Column, a: int, b: int) -> Column:
    return _shifted(text, lambda x: a * x + b)


def affine_decrypt(text: Column, a: int, b: int) -> Column:
    back = pow(a, -1, 95)
    return _shifted(text, lambda x: (x - b) * back)


def strip_fence(text: Column) -> Column:
    """Content of a fenced block, without the fence and the spaces around."""
    bare = F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), "^```(json)?", "")
    return F.btrim(F.regexp_replace(bare, "```$", ""), F.lit(" \t\r\n"))


# Where a JSON text may stand in an answer, in the order in which they are tried.
JSON_PLACES = [(r"(?s)\{.*\}", 0), (r"(?s)```json\s*(.*?)\s*```", 1), (r"(?s)```\s*(.*?)\s*```", 1)]


def outer_braces(text: Column) -> Column:
    """The JSON in a text: the outermost braces, else a fenced JSON block, else any fenced block; NULL if none parses."""
    found = [F.regexp_extract(text, pattern, group) for pattern, group in JSON_PLACES]
    return F.coalesce(*[F.when((x != "") & F.try_parse_json(x).isNotNull(), x) for x in found])


PIECE_BYTES = 1 << 20  # of text that are cut at once


def _cut(batches: Iterator[pa.RecordBatch], cuts: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        part = (np.cumsum(sizes) - sizes) // PIECE_BYTES
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() if len(part) else []
        for a, b in zip(edges, [*edges[1:], len(part)], strict=True):
            some = np.flatnonzero(texts[a:b].is_valid().to_numpy(zero_copy_only=False)) + a
            if not len(some):
                continue
            data = np.frombuffer(b"".join(texts.take(pa.array(some)).to_pylist()), np.uint8)
            ends = np.cumsum(sizes[some])
            begins = ends - sizes[some]
            letter = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
            at = np.flatnonzero(np.isin(data, np.frombuffer(cuts, np.uint8)))
            # Pieces begin with their text or after a cut, and end at a cut or with their text.
            owner = np.concatenate([np.arange(len(some)), np.searchsorted(ends, at, side="right")])
            order = np.argsort(owner, kind="stable")
            owner = owner[order]
            first = np.concatenate([begins, at + 1])[order]
            is_last = np.concatenate([owner[1:] != owner[:-1], [True]])
            last = np.where(is_last, ends[owner], np.concatenate([first[1:] - 1, [0]]))
            count = np.bincount(owner, minlength=len(some))
            number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some[owner])), pa.array(number.astype(np.int32)), pa.array(letter[first] - letter[begins[owner]]), pa.array(letter[last] - letter[first])],
                [batch.schema.names[0], "k", "start", "n"])


def pieces(texts: DataFrame, ident: str, text: str, cuts: str) -> DataFrame:
    """(ident, k, start, n): the parts of each text between any of the ASCII characters ``cuts``, numbered from 0, with their offsets and lengths in characters.

    Empty parts count. Texts are cut where they are, without a shuffle.
    """
    kind = texts.schema[ident].dataType
    schema = T.StructType([T.StructField(ident, kind), T.StructField("k", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType())])
    return texts.select(ident, text).mapInArrow(lambda batches: _cut(batches, cuts.encode()), schema)


LCS_CELLS = 1 << 24  # cells of the table of lengths held at once, as bits


def _lcs_places(right: str):
    """letter -> whole number with a bit for each place of it in ``right``."""
    if len(right) > 1000:
        codes = np.frombuffer(right.encode("utf-32-le", "surrogatepass"), np.uint32)
        places = {}

        def place(letter: str) -> int:
            if letter not in places:
                places[letter] = int.from_bytes(np.packbits(codes == ord(letter), bitorder="little").tobytes(), "little")
            return places[letter]

        return place
    few: dict[str, int] = {}
    for j, letter in enumerate(right):
        few[letter] = few.get(letter, 0) | 1 << j
    return lambda letter: few.get(letter, 0)


def _lcs_next(row: int, places: int, full: int) -> int:
    """A row of the table of lengths, one letter of the left string later; ``places`` are those of the letter on the right.

    A row is a whole number with a bit for each cell that is as large as the one before it; the others are larger by 1.
    """
    met = row & places
    return (row + met | row - met) & full


def _lcs_length(a: str, b: str) -> int:
    place, full = _lcs_places(b), (1 << len(b)) - 1
    row = full
    for letter in a:
        row = _lcs_next(row, place(letter), full)
    return len(b) - row.bit_count()


def _lcs_text(a: str, b: str, cells: int = LCS_CELLS) -> str:
    """The subsequence, walked from the ends over some rows of the table at a time.

    Rows at equal distances are kept; the rows between two of them are computed
    again when the walk gets there.
    """
    place, full = _lcs_places(b), (1 << len(b)) - 1
    step = max(1, min(int(len(a) ** 0.5) + 1, cells // (len(b) + 1)))
    row, kept = full, []
    for i, letter in enumerate(a):
        if i % step == 0:
            kept.append(row)
        row = _lcs_next(row, place(letter), full)
    i, j, found = len(a), len(b), []
    while i and j:
        first = (i - 1) // step * step
        rows = [kept[first // step]]
        for letter in a[first:i]:
            rows.append(_lcs_next(rows[-1], place(letter), full))
        # The length at (i, j) and at (i - 1, j), which are equal or differ by 1.
        below = (1 << j) - 1
        here = j - (rows[i - first] & below).bit_count()
        above = j - (rows[i - 1 - first] & below).bit_count()
        while i > first and j:
            left = here - (~rows[i - first] >> j - 1 & 1)  # at (i, j - 1)
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                found.append(a[i])
                here = above - (~rows[i - first] >> j & 1)
            elif above < left:
                above -= ~rows[i - 1 - first] >> j - 1 & 1
                j, here = j - 1, left
                continue
            else:
                i, here = i - 1, above
            if i > first:
                above = j - (rows[i - 1 - first] & (1 << j) - 1).bit_count()
    return "".join(reversed(found))


@F.pandas_udf(T.IntegerType())
def lcs_length(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two strings."""
    return pd.Series([None if a is None or b is None else _lcs_length(a, b) for a, b in zip(left, right)], dtype="Int32")


@F.pandas_udf(T.StringType())
def lcs_text(left: pd.Series, right: pd.Series) -> pd.Series:
    """The longest common subsequence itself; of several, the one found from the ends by preferring to drop from ``left``."""
    return pd.Series([None if a is None or b is None else _lcs_text(a, b) for a, b in zip(left, right)], dtype=object)
