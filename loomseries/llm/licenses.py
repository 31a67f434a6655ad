"""License scan by diagonal voting.

Every run of k words of every text is hashed, and Spark joins the hashes with
the places where the templates hold them. A hit votes for a diagonal: its place
in the text minus its place in the template. Votes are gathered by document,
template and diagonal. Neighbouring diagonals, which a few inserted or left out
words make of one passage, are merged, and a merged span counts if it covers
enough of the template's words and holds few others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words

CHUNK = 4096  # runs of words per row on their way to the join
REACH = 4  # words by which a passage may shift inside
NOTICE_K, LONG_K = 2, 4
LONG_SHARE = 0.75  # of a long template's words


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    k: int = NOTICE_K
    share: float = 1.0
    reach: int = 0
    base: bool = False


# Phrases of license names.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# Notices that are found word for word.
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "apache license version 2 0"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("cc-by", "cc by 4 0"),
    ("cc-by-nc", "cc by nc 4 0"),
    ("cc-by-sa", "cc by sa 4 0"),
    ("cc-by", "creative commons attribution 4 0"),
    ("cc0", "cc0 1 0 universal"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2.0", "mozilla public license version 2 0"),
]

# Passages of licenses, as published.
PASSAGES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
     "disclaimer"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
     "License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
     "with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software"),
]

TEMPLATES = [
    *[Template(label, text, base=True) for label, text in PHRASES],
    *[Template(label, text) for label, text in NOTICES],
    *[Template(label, text, LONG_K, LONG_SHARE, REACH) for label, text in PASSAGES],
]

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# One gram more for every text, which the table of templates holds as well: so no text is lost in the join.
MARK, MARK_TEMPLATE = -1, -1


@dataclass
class Grams:
    """Hashes of all runs of k words of some texts, with their text and place."""

    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray


class Scan:
    """Words of some texts: runs of letters and digits, A-Z as a-z, and of all characters beyond ASCII."""

    def __init__(self, texts: words.Texts):
        lowered = texts.lowered()
        self.n = len(texts)
        starts, ends = lowered.runs(_INSIDE[lowered.data])
        self.owner = texts.owner(starts)
        self.hashes = lowered.hashes(starts, ends)
        self.counts = np.bincount(self.owner, minlength=self.n)
        self.first = np.cumsum(self.counts) - self.counts

    def grams(self, k: int) -> Grams:
        at = np.arange(max(0, len(self.hashes) - k + 1))
        at = at[self.owner[at] == self.owner[at + k - 1]] if len(at) else at
        hashes = (words.grams(self.hashes, k, at) >> np.uint64(1)).astype(np.int64)
        return Grams(hashes, self.owner[at], at - self.first[self.owner[at]])


def template_grams(templates: list[Template]) -> list[tuple[int, int, int]]:
    """gram, template, place of all runs of words of the templates, and the mark."""
    out = [(MARK, MARK_TEMPLATE, 0)]
    for number, t in enumerate(templates):
        _, texts = next(words.texts_of(pa.array([t.text])))
        found = Scan(texts).grams(t.k)
        out += [(int(h), number, int(p)) for h, p in zip(found.hashes, found.place, strict=True)]
    return out


def template_sizes(templates: list[Template]) -> list[int]:
    return [int(Scan(next(words.texts_of(pa.array([t.text])))[1]).counts[0]) for t in templates]


def _gram_rows(scan: Scan, rows: np.ndarray, ids: pa.Array, sizes: list[int], chunk: int) -> pa.RecordBatch:
    """row, doc_id, at, grams: one mark for every text, its place the number of words, then all grams in chunks."""
    values, owner, at, counts = [np.full(scan.n, MARK, np.int64)], [rows], [scan.counts.astype(np.int64)], [np.ones(scan.n, np.int64)]
    for k in sizes:
        found = scan.grams(k)
        first = np.flatnonzero((np.diff(found.owner, prepend=-1) != 0) | (found.place % chunk == 0))
        values.append(found.hashes)
        owner.append(rows[found.owner[first]])
        at.append(found.place[first])
        counts.append(np.diff(first, append=len(found.hashes)))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
    ids = pa.concat_arrays([ids, pa.nulls(len(grams) - scan.n, pa.int64())])  # the mark alone carries the id
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(owner)), ids, pa.array(np.concatenate(at)), grams], ["row", "doc_id", "at", "grams"])


def gram_hits(docs: DataFrame, templates: list[Template], text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, template, tpos, dpos for every run of words that a template holds, and one mark a row."""
    sizes = sorted({t.k for t in templates})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for first, texts in words.texts_of(batch.column(2)):
                some = slice(first, first + len(texts))
                yield _gram_rows(Scan(texts), rows[some], batch.column(1)[some], sizes, chunk)

    slim = docs.select(F.monotonically_increasing_id(), F.col("doc_id").cast("long"), F.col(f"`{text}`"))
    chunks = slim.mapInArrow(run, "row long, doc_id long, at long, grams array<long>")
    grams = chunks.select("row", "doc_id", "at", F.posexplode("grams").alias("i", "gram"))
    held = docs.sparkSession.createDataFrame(template_grams(templates), "gram long, template int, tpos int")
    # The templates are a fixed list of a few hundred words.
    return grams.join(F.broadcast(held), "gram").select("row", "doc_id", "template", "tpos", (F.col("at") + F.col("i")).alias("dpos"))


def _covered(places: Column, k: Column) -> Column:
    """How many words the runs of ``k`` words at these places (sorted) cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1_000_000).alias("end"))

    def step(acc, p):
        return F.struct((acc["n"] + F.least(k, p + k - acc["end"])).alias("n"), (p + k).alias("end"))

    return F.aggregate(places, start, step, lambda acc: acc["n"])


def spans(hits: DataFrame, templates: list[Template]) -> DataFrame:
    """row, doc_id, template, label, base, first, last, score of every verified span; a mark is a span of template -1.

    All steps group by the row and more, so that they share the exchange by row.
    """
    sizes = template_sizes(templates)
    spec = [(n, t.label, t.base, t.k, size, float(t.share), t.reach) for n, (t, size) in enumerate(zip(templates, sizes, strict=True))]
    spec.append((MARK_TEMPLATE, None, False, 1, 1, 0.0, 0))
    table = hits.sparkSession.createDataFrame(spec, "template int, label string, base boolean, k int, size int, share double, reach int")
    diagonals = (
        hits.repartition("row")
        .groupBy("row", "template", (F.col("dpos") - F.col("tpos")).alias("diagonal"))
        .agg(F.max("doc_id").alias("doc_id"), F.collect_set("tpos").alias("places"), F.min("dpos").alias("first"), F.max("dpos").alias("last"))
        .join(F.broadcast(table), "template")
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.col("reach")
    merged = (
        diagonals.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "template", "span", "label", "base", "k", "size", "share")
        .agg(
            F.max("doc_id").alias("doc_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
            F.min("first").alias("first"), F.max("last").alias("last"))
    )
    length = F.col("last") + F.col("k") - F.col("first")
    score = _covered(F.col("places"), F.col("k")) / F.greatest(length, F.col("size"))
    verified = merged.withColumn("score", score).where("score >= share")
    return verified.select("row", "doc_id", "template", "label", "base", "first", (F.col("first") + length - 1).alias("last"), "score")


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    n_base counts the places of the base phrases (``Template.base``), first_word
    and last_word are the smallest and largest of their starts, else NULL;
    labels are distinct, sorted and joined by commas; score is the best span's:
    the template's words it covers over its length or the template's, whichever
    is more, 0 without a span. A NULL or empty text has no words. Repeated
    rows and rows without a doc_id are scanned each on their own, an empty table
    gives none, other columns are not looked at. Texts of any length are scanned
    whole.
    """
    found = spans(gram_hits(docs, templates, text), templates)
    mark = F.col("template") == MARK_TEMPLATE
    names = lambda which: F.array_join(F.array_sort(F.collect_set(which)), ",")
    return (
        found.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"), F.max(F.when(mark, F.col("first"))).alias("n_words"), F.count(F.when(F.col("base"), 1)).alias("n_base"),
            F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
            names(F.when(F.col("base"), F.col("label"))).alias("base_labels"), names(F.col("label")).alias("labels"),
            F.coalesce(F.max(F.when(~mark, F.col("score"))), F.lit(0.0)).alias("score"))
        .drop("row")
    )


def _oracle(templates: list[Template]) -> str:
    rows = ", ".join(
        f"({n}, '{t.label}', '{t.text}', {t.k}, {float(t.share)}::DOUBLE, {t.reach}, {str(t.base).lower()})" for n, t in enumerate(templates))
    grams = {k: " || ' ' || ".join(f"w[i + {j}]" for j in range(k)) for k in sorted({t.k for t in templates})}

    def runs(columns: str, table: str) -> str:
        one = "SELECT {c}, unnest(g) AS gram, unnest(range(len(g))) AS pos FROM (SELECT *, list_transform(range(1, len(w) - {l}), lambda i: {e}) AS g FROM {t}{w})"
        return " UNION ALL ".join(
            one.format(c=columns if table == "tw" else f"{columns}, {k} AS k", l=k - 2, e=e, t=table, w=f" WHERE k = {k}" if table == "tw" else "")
            for k, e in grams.items())

    return f"""
WITH templates AS (SELECT * FROM (VALUES {rows}) t(template, label, text, k, share, reach, base)),
tw AS (SELECT template, label, k, share, reach, base, {_WORDS} AS w FROM templates),
dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
tg AS ({runs("template, k", "tw")}),
dg AS ({runs("r", "dw")}),
diagonals AS (
  SELECT r, template, dg.pos - tg.pos AS d, list(DISTINCT tg.pos) AS places, min(dg.pos) AS a, max(dg.pos) AS b
  FROM dg JOIN tg USING (k, gram) GROUP BY ALL),
told AS (SELECT *, coalesce(d - lag(d) OVER w > reach, true)::INTEGER AS new, len(tw.w) AS size
  FROM diagonals JOIN tw USING (template) WINDOW w AS (PARTITION BY r, template ORDER BY d)),
spanned AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY d) AS span FROM told),
merged AS (
  SELECT r, template, label, base, k, size, share, list_sort(list_distinct(flatten(list(places)))) AS s, min(a) AS a, max(b) AS b
  FROM spanned GROUP BY r, template, span, label, base, k, size, share),
scored AS (
  SELECT *, list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i = len(s) THEN k ELSE least(k, s[i + 1] - s[i]) END))::DOUBLE
    / greatest(b + k - a, size) AS score FROM merged),
verified AS (SELECT * FROM scored WHERE score >= share),
named AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
    max(score) AS score FROM verified GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM dw LEFT JOIN named USING (r)
"""


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE = _oracle(TEMPLATES)
