"""Lines of any length take part, and large nodes are cut."""

import random

import numpy as np
import pyarrow as pa

from test_linededup import corpus, frame, result
from test_linededup import shingles as tokens

from loomseries.llm import linededup


def brute(docs):
    """doc -> text without the lines that match an earlier one, and their numbers; a line of 1 to 4 words is one token."""
    seen, out = [], {}
    for doc_id, text in sorted(docs):
        lines, gone = text.split("\n"), []
        for i, line in enumerate(lines):
            s = tokens(line)
            if s and any(4 * len(s & t) >= 3 * len(s | t) for t in seen):
                gone.append(i)
            if s:
                seen.append(s)
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), gone)
    return out


def test_short_lines(spark):
    docs = [(1, "les.\na b c d\nx  Y\n\n \nles"), (2, "LES.\nb a c d\nx y\n\na b c"), (3, "a\tB c d\nx y z\nles.\r\nd"), (4, "a b c d e\na b c d\na b c d e\nd")]
    out = result(linededup.dedup_lines(frame(spark, docs)))
    assert out == brute(docs)
    assert {k: gone for k, (_, gone) in out.items()} == {1: [], 2: [0, 2], 3: [0, 2], 4: [1, 2, 3]}


def test_short_and_long_lines_as_all_pairs(spark):
    docs = [(d, t + "\n" + random.Random(d).choice(["x y z", "x Y", "o"])) for d, t in corpus(8, 120)]
    assert result(linededup.dedup_lines(frame(spark, docs).repartition(5))) == brute(docs)


def family(seed, n):
    """Near copies of one line, far enough from each other to stay open in part."""
    rng = random.Random(seed)
    base = [str(rng.randrange(10**6)) for _ in range(60)]
    docs = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = str(rng.randrange(10**6))
        docs.append((1000 + i, "x y z\n" + " ".join(w)))
    return docs


def test_hot_nodes_as_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 4)
    monkeypatch.setattr(linededup, "BLOCK", 3)
    monkeypatch.setattr(linededup, "PART_LINES", 5)
    docs = corpus(6, 60) + family(1, 60)
    assert result(linededup.dedup_lines(frame(spark, docs).repartition(5))) == brute(docs)


def test_hot_nodes_are_dealt_by_set():
    n, parts = 400, 16
    texts = pa.array([f"same five words here now then {i} a{i} b{i} c{i} d{i}" for i in range(n)])
    codes = np.full(1 << linededup.BUCKET_BITS, linededup._code(linededup.HOT), np.uint8)
    codes = type("Held", (), {"value": codes})
    packed = list(linededup._packed(codes, parts, int(linededup._code(linededup.HOT)))(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
    node = {}
    for batch in packed:
        for part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for x in np.frombuffer(data, linededup._ENTRY)["node"]:
                node.setdefault(int(x), []).append(part)
    largest = max(node.values(), key=len)
    assert len(largest) > 50 and len(set(largest)) > 10


def test_known_rows_are_copied_for_open_blocks_only(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BLOCK", 10)
    rows = spark.range(1000).selectExpr(
        "1L node", "id h", "9 n", "0 pos", "1000L size", "struct(id as doc_id, id as row, 0 as line) first", "id = 500 as open", "1L opens")
    copies = {r.open: r["count"] for r in linededup._cells(rows).groupBy("open").count().collect()}
    assert copies == {False: 999, True: 101}
