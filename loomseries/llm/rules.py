"""Quality rules, line by line first.

Each line with a word is judged: it fails if it doesn't end like a sentence, if
it shouts, if signs or separators stand for words as in menus and tables, or if
it holds a phrase of boilerplate. Failing lines are removed. A document that
loses more than half of its characters that way is rejected, as is one that
fails the base rules (too few words, or too many words in repeated passages).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

MIN_WORDS = 10
MAX_REPEAT = 20  # per cent of the words
WINDOW = 5
MAX_LOST = 50  # per cent of the characters in words
SIGNS_PER_WORD = 20  # per cent; from here on signs, or exclamation marks, stand for words
MIN_SIGNS = 3

SYMBOLS = "#*$%&|<>"
# A sentence ends with one of these, after which a quote or bracket may close.
ENDINGS = ".!?:;\"')]…”’»。！？"
BOILERPLATE = [
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "terms and conditions",
    "click here", "sign up for our newsletter", "subscribe to our newsletter", "enable javascript", "skip to content", "back to top",
    "share on facebook", "powered by wordpress", "lorem ipsum",
]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_SHORT_END = np.zeros(256, bool)
_SHORT_END[[ord(c) for c in ENDINGS if ord(c) < 128]] = True
_LONG_ENDS = [c.encode() for c in ENDINGS if ord(c) > 127]

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_failed_lines long, lost_chars long"
)


def _keys(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One number for text and hash."""
    return owner.astype(np.uint64) << np.uint64(52) | hashes >> np.uint64(12)


def _ends_like_a_sentence(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """By the last bytes before each of ``ends``."""
    good = _SHORT_END[data[ends - 1]]
    for sign in _LONG_ENDS:
        at = ends - len(sign)
        match = at >= 0
        for i, b in enumerate(sign):
            match &= data[np.maximum(at, 0) + i] == b
        good |= match
    return good


def judge(texts: words.Texts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts by text; and start, end and failure of every line."""
    n, data = len(texts), texts.data
    starts, ends = texts.words()
    hashes, owner = texts.hashes(starts, ends), texts.owner(starts)
    per_text = lambda values: np.bincount(owner if values is None else values, minlength=n)

    def sums(flags):
        return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])

    chars = sums(~words.BLANK[data] & ((data & 0xC0) != 0x80))
    symbols = sums(_SYMBOL[data])
    shouts = sums(data == ord("!"))

    # Words covered by a window that is there twice.
    last = len(owner) - WINDOW + 1
    at = np.flatnonzero(owner[:last] == owner[WINDOW - 1 :]) if last > 0 else np.zeros(0, np.int64)
    _, group, count = np.unique(_keys(owner[at], words.grams(hashes, WINDOW, at)), return_inverse=True, return_counts=True)
    again = at[count[group] > 1]
    steps = np.bincount(again, minlength=len(owner) + 1) - np.bincount(again + WINDOW, minlength=len(owner) + 1)[: len(owner) + 1]
    covered = np.cumsum(steps)[: len(owner)] > 0

    # Lines, and those with a word.
    first, stop = texts.lines()
    line = np.searchsorted(first, starts, side="right") - 1
    line_words = np.bincount(line, minlength=len(first))
    some = np.flatnonzero(line_words)
    line_owner = texts.owner(first[some])
    same = words.distinct(_keys(line_owner, texts.hashes(first[some], stop[some])))
    n_lines = per_text(line_owner)
    dup_lines = n_lines - per_text((same >> np.uint64(52)).astype(np.int64))

    last_word = np.cumsum(line_words)[some] - 1
    failed = ~_ends_like_a_sentence(data, ends[last_word])
    for marks in (symbols, shouts):
        found = marks[stop[some]] - marks[first[some]]
        failed |= (found >= MIN_SIGNS) & (100 * found >= SIGNS_PER_WORD * line_words[some])
    all_failed = np.zeros(len(first), bool)
    all_failed[some] = failed
    lowered = words.LOWER[data].tobytes()
    for phrase in BOILERPLATE:
        p = phrase.encode()
        place = lowered.find(p)
        while place >= 0:
            k = int(np.searchsorted(first, place, side="right")) - 1
            all_failed[k] |= place + len(p) <= stop[k]
            place = lowered.find(p, place + 1)
    lost = chars[stop[some]] - chars[first[some]]
    gone = all_failed[some]

    out = {
        "n_words": per_text(None),
        "word_chars": np.diff(chars[texts.bounds]),
        "n_symbols": np.diff(symbols[texts.bounds]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": per_text(owner[covered]),
    }
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT * out["n_words"])
    lost_chars = np.bincount(line_owner[gone], lost[gone], minlength=n).astype(np.int64)
    out["kept"] = ~out["base_failed"] & (100 * lost_chars <= MAX_LOST * out["word_chars"])
    out |= {"n_lines": n_lines, "n_failed_lines": per_text(line_owner[gone]), "lost_chars": lost_chars}
    return out, first, stop, all_failed


def _cleaned(texts: words.Texts, first: np.ndarray, stop: np.ndarray, failed: np.ndarray) -> list[str]:
    """The texts without their failed lines."""
    data, out = texts.data.tobytes(), []
    # Lines are in the order of the texts; a text has one line more than line breaks.
    breaks = np.concatenate([[0], np.cumsum(texts.data == 10)])
    at = 0
    for i in range(len(texts)):
        a, b = int(texts.bounds[i]), int(texts.bounds[i + 1])
        n = int(breaks[b] - breaks[a]) + 1
        if failed[at : at + n].any():
            out.append(b"\n".join(data[first[k] : stop[k]] for k in range(at, at + n) if not failed[k]).decode())
        else:
            out.append(data[a:b].decode())
        at += n
    return out


def apply_rules(docs: DataFrame, text: bool = False) -> DataFrame:
    """Counts and verdict for every row of ``docs`` (doc_id, text); with ``text`` also ``clean_text``, without failed lines.

    A NULL text counts as empty: no words, so it fails the base rules. Repeated
    rows get equal results, a NULL doc_id stays NULL, an empty table gives an
    empty result. Texts are read whole, other columns are not looked at.
    n_lines and n_failed_lines count lines with a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in words.texts_of(batch.column(1)):
                found, *lines = judge(texts)
                columns = {"doc_id": batch.column(0).slice(row, len(texts))} | {k: pa.array(v) for k, v in found.items()}
                if text:
                    columns["clean_text"] = pa.array(_cleaned(texts, *lines), pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, RESULT + (", clean_text string" if text else ""))


_MARKS = "".join("''" if c == "'" else "\\" + c if c in "\"]).?" else c for c in ENDINGS)

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
grams AS (
  SELECT r, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r),
lines AS (
  SELECT r, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    length(line) - length(regexp_replace(line, '[{SYMBOLS}]', '', 'g')) AS symbols,
    length(line) - length(replace(line, '!', '')) AS shouts
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (
  SELECT *, NOT regexp_matches(line, '[{_MARKS}][\x20\x09-\x0D]*$')
    OR symbols >= {MIN_SIGNS} AND 100 * symbols >= {SIGNS_PER_WORD} * n
    OR shouts >= {MIN_SIGNS} AND 100 * shouts >= {SIGNS_PER_WORD} * n
    OR {" OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)} AS failed
  FROM lines),
by_doc AS (
  SELECT r, count(*) - count(DISTINCT line) AS dups, count(*) AS n_lines, count(*) FILTER (failed) AS n_failed,
    coalesce(sum(chars) FILTER (failed), 0) AS lost
  FROM judged GROUP BY r),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_failed, 0)::BIGINT AS n_failed_lines, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN by_doc USING (r)),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= {MAX_LOST} * word_chars AS kept, n_lines, n_failed_lines, lost_chars
FROM based
"""
