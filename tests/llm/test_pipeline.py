import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from test_linededup import brute as brute_lines
from test_minhash import brute as brute_near
from test_rules_topk_mixing import plain

import corpus_pipeline
from loomseries.llm import bpe, mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(700)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for _ in range(120):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(4, 60))) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), passage)
        text = "\n".join(lines)
        rows.append(text)
        for _ in range(rng.choice([0, 0, 1, 4])):
            w = text.split(" ")
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(10**6))
            rows.append(" ".join(w))
    rows += ["", None, "123 456", "!!!", rows[0], rows[0]]
    rng.shuffle(rows)
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), 0 if t is None else len(t)) for i, t in enumerate(rows)]


def by_hand(spark, rows, encoding):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    lines = brute_lines([r[:2] for r in rows])
    rows = [(d, lines[d][0], lang, source, len(lines[d][0])) for d, _, lang, source, _ in rows if lines[d][0].split() or not lines[d][1]]
    kept = {d for none, d, _, _, k in brute_near([r[:2] for r in rows]) if k}
    rows = [r for r in rows if r[0] in kept]
    mixed = mixing.mix(spark.createDataFrame(rows, COLUMNS)).collect()  # compared with SQL in its own test
    out = []
    for r in mixed:
        ids = b"".join(i.to_bytes(4, "little") for i in encoding.encode_ordinary(r.text))
        out.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_stages_by_hand(spark, tmp_path, encoding):
    rows = documents()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert plain(out) == plain(by_hand(spark, rows, encoding))


def test_stage_by_stage(spark, tmp_path):
    rows = documents() + [(5, "once more the same text", "en", "a", 23)] * 2 + [(None, "no id here at all but text", None, None, None)]
    extra = COLUMNS + ", _gone string, copy int, n_lines long, lang_pred string, row long"
    docs = spark.createDataFrame([(*r, "g", 1, 2, "p", 3) for r in rows], extra)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "line_dedup", "near_dedup", "mix", "encode"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(str(tmp_path / name))
        docs = stage(spark, spark.read.parquet(str(tmp_path / name)), str(tmp_path))
        assert docs.columns == [c.split()[0] for c in extra.split(", ")], name
        if name != "mix":
            assert 0 < docs.count() <= before
    assert docs.where("lang is null and text rlike '[a-z]'").count() == 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
