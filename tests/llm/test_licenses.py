"""License spans against plain loops, and texts altered by hand."""

import random
import re

import pytest

from loomseries.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base_places(text):
    one = words_of(text)
    out = []
    for label, phrase in licenses.PHRASES:
        want = phrase.split()
        out += [(i, label) for i in range(len(one)) if one[i : i + len(want)] == want]
    return out


def by_hand(text):
    """Everything by the definition: hits, diagonals, merging, covered words."""
    one, found = words_of(text), []
    for t in licenses.TEMPLATES:
        other = words_of(t.text)
        at = {}
        for i in range(len(one) - t.k + 1):
            for j in range(len(other) - t.k + 1):
                if one[i : i + t.k] == other[j : j + t.k]:
                    at.setdefault(i - j, []).append((i, j))
        clusters, last = [], None
        for d in sorted(at):
            if last is None or d - last > t.reach:
                clusters.append([])
            clusters[-1] += at[d]
            last = d
        for hits in clusters:
            covered = len({j + x for _, j in hits for x in range(t.k)})
            first, end = min(i for i, _ in hits), max(i for i, _ in hits) + t.k
            score = covered / max(end - first, len(other))
            if score >= t.share:
                found.append((t.label, score))
    places = base_places(text)
    return (
        len(one), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None),
        ",".join(sorted({x for _, x in places})), ",".join(sorted({x for x, _ in found})), max((s for _, s in found), default=0.0))


def made(n=120, seed=2):
    rnd = random.Random(seed)
    parts = [t.text for t in licenses.TEMPLATES] + ["mit", "license", "general", "public", "été", "the software", "\n", "GNU", "version 3", "MIT\nLicense!"]
    out = []
    for _ in range(n):
        some = [rnd.choice(parts) for _ in range(rnd.randint(0, 6))]
        flat = " ".join(some).split(" ")
        for _ in range(rnd.choice([0, 1, 3, 9])):
            if flat:
                at = rnd.randrange(len(flat))
                flat[at : at + rnd.randint(0, 2)] = ["odd"] * rnd.randint(0, 2)
        out.append(" ".join(flat))
    return out


@pytest.mark.parametrize("chunk", [4096, 3])
def test_against_loops(spark, monkeypatch, chunk):
    monkeypatch.setattr(licenses.gram_hits, "__defaults__", ("text", chunk))
    texts = made() + [None, "", "...", "mit license " * 700, "x " * 9000 + "Apache-License"]
    rows = [(i if i % 40 else None, t, "clash", 1) for i, t in enumerate(texts)]
    rows += rows[3:9]
    docs = spark.createDataFrame(rows, "doc_id long, text string, template string, row int").repartition(5)
    got = licenses.scan(docs)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = sorted(str((r[0], *by_hand(r[1]))) for r in rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_altered_passage_is_found(spark):
    passage = licenses.PASSAGES[0][1].split(" ")
    altered = " ".join(passage[:20] + ["and", "also"] + passage[20:40] + passage[41:])
    half = " ".join(passage[:25])
    docs = spark.createDataFrame([(1, "before " * 50 + altered + " after"), (2, half), (3, "the rights to use copy this software")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels, r.score) for r in licenses.scan(docs).collect()}
    assert got[1][:2] == ("mit", "") and 0.9 < got[1][2] < 1
    assert got[2] == got[3] == ("", "", 0.0)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
