"""Resampling against a plain loop over every feature."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from loomseries.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LETTERS = "abcAÉé日 .\n-1_"


def found(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    one = WORD.findall(text)
    return one, one + [f"{x} {y}" for x, y in zip(one, one[1:], strict=False)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def by_hand(rows, target, buckets=importance.BUCKETS):
    counts = [[0] * buckets, [0] * buckets]
    for side, texts in enumerate(([t for _, t in rows], target)):
        for t in texts:
            for f in found(t)[1]:
                counts[side][bucket(f, buckets)] += 1
    s, t = map(sum, counts)
    gain = [math.floor(1000 * math.log((y + 1) * (s + buckets) / ((x + 1) * (t + buckets)))) for x, y in zip(*counts, strict=True)]
    out = []
    for doc_id, text in rows:
        one, all_ = found(text)
        weight = sum(gain[bucket(f, buckets)] for f in all_) // len(all_) if all_ else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(all_), weight, score, None, len(one)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: 25 * len(able) // 100], 1):
        row[4] = rank
    return sorted(str(tuple(r[:5])) for r in out)


def made(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.choice([0, 5, 60, 200]))) for _ in range(n)]


def test_against_a_loop(spark):
    texts = made(300) + [None, "", "...", "Ab" * 3000, "w é " * 4000]
    rows = [(i if i % 90 else None, t) for i, t in enumerate(texts)]
    rows += rows[:7]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, rank string, weight double").repartition(4)
    target = made(20, 2) + [None]
    other = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(docs, other)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in out.collect()) == by_hand(rows, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = importance.resample(one, none)
    assert sorted(str(tuple(r)) for r in out.collect()) == by_hand([(1, "a b"), (2, None)], [])


def test_long_texts_in_parts():
    texts = pa.array([" ".join(made(40, 3)), "a b", None, "x" * 400, " . " * 200, "é" + " word" * 90], pa.string())
    whole = importance.features(texts, 97)
    total, n = np.zeros(97, np.int64), 0
    for _, part, later in importance.pieces(texts, 50):
        got = importance.features(part, 97)
        total += got.counts(97)
        if later and len(got.singles):
            total[got.singles[0]] -= 1
        n += 1
    assert n > 20 and total.tolist() == whole.counts(97).tolist()


def test_checksums_of_joined_words():
    rnd = random.Random(4)
    pairs = [(rnd.randbytes(rnd.randint(0, 9)), rnd.randbytes(rnd.choice([0, 1, 2, 7, 64, 1000, 70_000]))) for _ in range(200)]
    crc = [np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1)]
    got = importance.joined_crc(*crc, np.array([len(y) for _, y in pairs]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in pairs]
