import random
import re

import pytest

from loomseries.llm import linededup

DOCS = "doc_id long, text string, line string, row int, h string, gone int, doc string, n_lines string"


def shingles(line):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", line)]
    if len(w) < 5:  # a line of 1 to 4 words is one token
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs):
    """doc -> text without the lines that match an earlier one. Doc ids are different here."""
    seen, out = [], {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        if text is None:
            out[doc_id] = (None, [])
            continue
        kept, gone = [], []
        for i, line in enumerate(text.split("\n")):
            s = shingles(line)
            if s and any(4 * len(s & t) >= 3 * len(s | t) for t in seen):
                gone.append(i)
            else:
                kept.append(line)
            if s:
                seen.append(s)
        out[doc_id] = ("\n".join(kept), gone)
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefg", k=rng.randint(1, 5))) for _ in range(300)]
    common = [" ".join(rng.choices(vocabulary, k=k)) for k in (4, 5, 6, 9, 20, 70)]
    pool = []
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.25:
                lines.append(rng.choice(common))
            elif kind < 0.5 and pool:
                w = rng.choice(pool).split(" ")
                for _ in range(rng.randint(0, 2)):
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
                lines.append((" " * rng.randint(1, 2)).join(w).upper() if rng.random() < 0.3 else " ".join(w))
            else:
                lines.append(" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 8, 15, 40, 120]))))
                if lines[-1]:
                    pool.append(lines[-1])
        docs.append((i * 3, "\n".join(lines)))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "l", 1, "h", 2, "d", "n") for d, t in docs], DOCS)


def result(df):
    return {r.doc_id: (r.text, r.removed_lines) for r in df.collect()}


@pytest.mark.parametrize("few", [False, True])
def test_same_lines_as_all_pairs(spark, monkeypatch, few):
    if few:
        monkeypatch.setattr(linededup, "BLOCK", 3)
        monkeypatch.setattr(linededup, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(linededup, "PART_LINES", 5)
    docs = corpus(4 + few, 150)
    rng = random.Random(1)
    base = [str(rng.randrange(10**6)) for _ in range(60)]
    for i in range(70):  # one large group of near copies of a line
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = str(rng.randrange(10**6))
        docs.append((1000 + i, "x y z\n" + " ".join(w)))
    out = linededup.dedup_lines(frame(spark, docs).repartition(5))
    assert result(out) == brute(docs)
    for r in out.collect():
        assert (r.n_removed, r.line, r.row, r.doc) == (len(r.removed_lines), "l", 1, "d")
        assert r.n_lines == len(dict(docs)[r.doc_id].split("\n"))


def test_odd_rows(spark):
    line = "one two three four five six seven"
    many = "\n".join(f"{i} {i + 1} {i + 2} {i + 3} {i + 4} {i % 50}" for i in range(6000))
    docs = [(None, line), (1, None), (2, ""), (3, "\n\n"), (4, line + "\n" + line.upper() + "\n" + line.replace(" ", "  ")), (5, many), (6, "a b\n" + many[:60_000] + "\nz"),
            (7, " ".join(map(str, range(80_000)))), (8, " ".join(map(str, range(5, 80_003)))), (9, line + "\r\nab")]
    assert result(linededup.dedup_lines(frame(spark, docs))) == brute(docs)


def test_repeated_rows_are_one_row(spark):
    line = "one two three four five six seven"
    rows = linededup.dedup_lines(frame(spark, [(1, line), (1, line), (1, line + "\n" + line + "\n."), (2, "x\n" + line)])).collect()
    assert sorted((r.doc_id, r.text) for r in rows if r.doc_id == 2) == [(2, "x")]
    same = sorted(r.text for r in rows if r.doc_id == 1)
    # Either text may be the first of doc 1; equal rows get equal results, and the line stays somewhere.
    assert same in ([".", line, line], ["", "", line + "\n."])


def test_no_rows(spark):
    out = linededup.dedup_lines(frame(spark, []))
    assert out.count() == 0 and out.columns == [*DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")[:-1], "n_lines", "n_removed", "removed_lines"]
