import collections
import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from loomseries.llm import mixing, queries, rules, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy string, r int"


def duck(docs):
    db = duckdb.connect()
    frame = pd.DataFrame(docs, columns=[c.split()[0] for c in DOCS.split(", ")]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    db.register("documents", frame)
    return db


def plain(rows):
    return sorted((tuple(None if x is None or x != x else x for x in r) for r in rows), key=repr)


GOOD = "This is a whole line of words that ends well, and goes on for long enough."
MENU = "Home | About | Contact | Login | Help"
TEXTS = [
    None, "", "\n\n", " \t ", "short one.", GOOD + "\n" + MENU, MENU + "\n" + MENU + "\n" + GOOD, (GOOD + "\n") * 3, GOOD.upper().replace(" ", "!! "),
    "a b c d e " * 30, "Ends with a quote.” \n" + GOOD, GOOD + "\nAll Rights Reserved by nobody in this place.", "你好 " * 12 + "。",
    " ".join(map(str, range(9000))) + ".", "x y z.\r\n" + GOOD + "\r\n\x0b\x0c" + GOOD, "É" * 5 + " w" * 12, "one two three four five six one two three four five seven.",
    "privacy\npolicy " + GOOD, GOOD + "…", "#a #b #c " + GOOD, "…", "”.", "no line break at the end of a document without a full stop\n" + GOOD,
]


def test_rules_equal_sql(spark):
    docs = [(i, t, "en", "s", 1, "c", 1) for i, t in enumerate(TEXTS)] + [(4, "short one.", "en", "s", 1, "c", 1), (None, GOOD, None, None, None, None, None)]
    want = duck(docs).execute(rules.ORACLE)
    names = [c[0] for c in want.description]
    got = rules.apply_rules(spark.createDataFrame(docs, DOCS)).select(*names).collect()
    assert plain(got) == plain(want.fetchall())


def test_cleaned_text(spark):
    docs = [(1, MENU + "\n" + GOOD + "\n\nno end\n", "", "", 1, "", 1), (2, GOOD, "", "", 1, "", 1), (3, None, "", "", 1, "", 1), (4, MENU, "", "", 1, "", 1)]
    out = {r.doc_id: r for r in rules.apply_rules(spark.createDataFrame(docs, DOCS), text=True).collect()}
    assert out[1].clean_text == GOOD + "\n\n" and out[2].clean_text == GOOD and out[3].clean_text == "" and out[4].clean_text == ""
    assert (out[1].n_lines, out[1].n_failed_lines) == (3, 2)
    assert [out[i].kept for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert rules.apply_rules(spark.createDataFrame([], DOCS)).count() == 0


def brute_top(vectors, queries_, k):
    out = []
    for q, a in queries_.items():
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), v) for v, b in vectors.items() if v != q)
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("lists", [1, 2, 3, 5])
def test_top_k_equals_all_pairs(spark, monkeypatch, lists):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(lists)
    rows = {int(i): [int(x) for x in rng.integers(-40, 40, rng.choice([0, 3, 8]))] for i in range(200)}
    rows |= {1000 + i: [7] * 8 for i in range(80)} | {2000: [10**14] * 8, 2001: [-(10**14)] * 8, 2002: []}
    asked = {i: rows[i] for i in (0, 50, 100, 1000, 1050, 2000, 2001, 2002)} | {-5: [1, 2, 3]}
    schema = "id long, v array<long>, rank int, score string"
    as_frame = lambda d: spark.createDataFrame([(i, v, 1, "") for i, v in d.items()] + [(None, [1], 0, ""), (7777, None, 0, "")], schema)
    want = [(q, r, v, min(max(s, -(2**63)), 2**63 - 1)) for q, r, v, s in brute_top(rows, asked, 5)]
    got = sorted(tuple(r) for r in topk.search(as_frame(rows), as_frame(asked), 5, lists).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(want)


def test_few_candidates_repeated_ids_and_none(spark):
    schema = "id long, v array<long>"
    two = spark.createDataFrame([(1, [1, 2]), (1, [3, 4]), (2, [1, 1])], schema)
    assert [tuple(r) for r in topk.search(two, two, 5).orderBy("query_id").collect()] == [(1, 1, 2, 7), (2, 1, 1, 7)]
    none = spark.createDataFrame([], schema)
    assert topk.search(none, none, 5).count() == 0 and topk.search(two, none, 5).count() == 0 and topk.search(none, two, 5).count() == 0


def test_queries_go_to_blocks_that_can_reach_the_cutoff():
    """Every pair that reaches the cutoff is at a centre the query is sent to; with separate groups few others are."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-500, 500, (6, 8))
    rows = (middles[rng.integers(0, 6, 300)] + rng.integers(-9, 10, (300, 8))).tolist()
    batch = pa.record_batch({"id": pa.array(range(300)), "v": pa.array(rows, pa.list_(pa.int64()))})
    for lists in (1, 2, 3):
        map_ = topk._Map(middles, lists)
        filed = pa.Table.from_batches(map_.file([batch]))
        centre, far = filed["centre"].to_numpy(), np.array(filed["far"].to_pylist())
        map_.blocks, map_.starts = np.ones(6, int), np.arange(6)
        map_.radii = np.array([far[centre == i].max(axis=0) for i in range(6)])
        scores = np.array(rows) @ np.array(rows).T
        cutoff = np.sort(scores, axis=1)[:, -5]
        asked = batch.append_column("cutoff", pa.array([None, *cutoff[1:].tolist()], pa.int64()))
        sent = pa.Table.from_batches(map_.reach([asked]))
        pairs = set(zip(sent["id"].to_pylist(), sent["centre"].to_pylist(), strict=True))
        assert {(int(q), int(centre[v])) for q, v in zip(*np.nonzero(scores >= cutoff[:, None]), strict=True)} <= pairs
        assert {c for q, c in pairs if q == 0} == set(range(6)) and len(pairs) < 3 * 300
        first = pa.Table.from_batches(map_.first([batch]))
        assert len(first) == 2 * 300 and set(first["block"].to_pylist()) <= set(range(6))


def test_cutoffs_beyond_the_scores_of_a_block(spark, monkeypatch):
    """Blocks of small numbers meet cutoffs from blocks of large ones, in each kind of number."""
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 6)
    rows = {i: [i % 5 - 2, i % 3] for i in range(40)} | {100 + i: [3 * 10**6 + i, 5] for i in range(8)} | {200 + i: [-(10**9), i] for i in range(8)}
    asked = {i: rows[i] for i in (0, 3, 7, 104, 203)} | {-1: [1, 0], -2: [-1, 0]}
    as_frame = lambda d: spark.createDataFrame(list(d.items()), "id long, v array<long>")
    for lists, spans in ((1, 500), (2, 0)):
        monkeypatch.setattr(topk, "SPANS", spans)
        out = topk.search(as_frame(rows), as_frame(asked), 5, lists)
        assert ("SortMergeJoin [centre" in out._jdf.queryExecution().executedPlan().toString()) == (spans == 0)
        got = sorted(tuple(r) for r in out.collect())
        assert got == sorted(brute_top(rows, asked, 5))


def test_quantised_vectors(spark):
    rows = [(1, [0.5, -0.001], 1), (2, [math.nan], 1), (3, [None], 1), (4, None, 1), (5, [], 1), (6, [math.inf], 1), (7, [-math.inf, 1.0], 1)]
    out = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")).collect()
    assert sorted((r.id, r.v) for r in out) == [(1, [128, -1]), (5, [])]


def mixed_rows():
    rng = random.Random(4)
    rows = [(i, "w" * rng.randint(0, 60), "en", rng.choice(["a", "a", "a", "b", "c", None]), i, "x", i) for i in range(500)]
    return rows + [(500, None, None, "empty", None, None, None), (501, "", "", "empty", 0, "", 0), (None, "z", "", "b", 0, "", 0), (3, "again", "", "b", 0, "", 0)]


def test_mixing_equals_sql(spark):
    docs = mixed_rows()
    got = mixing.mix(spark.createDataFrame(docs, DOCS))
    assert sorted(got.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "r", "copy", "shuffle_key"])
    sql = mixing.ORACLE.replace("FROM copied", "FROM copied ORDER BY shuffle_key")
    want = duck(docs).execute(sql).fetchall()
    names = ["doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"]
    rows = got.select(*names).collect()
    assert plain(rows) == plain(want)
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)


def test_mixing_in_many_partitions(spark, monkeypatch):
    """Order and rows don't depend on the number of partitions, nor on how the rates come to the rows."""
    df = spark.createDataFrame(mixed_rows(), DOCS)
    names = ["doc_id", "text", "source", "copy", "shuffle_key"]
    want = mixing.mix(df).select(*names).collect()
    monkeypatch.setattr(mixing, "LARGE", 1000)
    monkeypatch.setattr(mixing, "NUMBERS", 0)
    out = mixing.mix(df).select(*names)
    assert out.rdd.getNumPartitions() > 20
    rows = out.collect()
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    assert collections.Counter(rows) == collections.Counter(want)


def test_mixing_shuffles_texts_once(spark, tmp_path):
    spark.createDataFrame(mixed_rows(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    plan = mixing.mix(spark.read.parquet(str(tmp_path / "documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange shuffle") + plan.count("Exchange hash") + plan.count("Exchange range") <= 1, plan


def test_given_weights_and_high_rates(spark):
    docs = [(i, "w" * 10, "en", "big" if i % 10 else "small", i, "x", i) for i in range(1000)]
    df = spark.createDataFrame(docs, DOCS)
    out = mixing.mix(df, {"big": 1.0, "small": 1.0}, epochs=2.0)
    by = collections.Counter(r.source for r in out.collect())
    assert abs(by["small"] - 1000) < 130 and abs(by["big"] - 1000) < 130
    assert set(r.source for r in mixing.mix(df, {"small": 3.0}).collect()) == {"small"}
    assert mixing.mix(df, {}).count() == 0 and mixing.mix(df.where("false")).count() == 0
    one = df.where("doc_id = 10")
    high = mixing.mix(one, epochs=2600.0)
    assert mixing.rates(one, epochs=2600.0).first().parts == 6
    assert abs(high.count() - 2600) < 300
    n = high.agg({"copy": "max"}).first()[0]
    assert n == high.count()


def test_counts_follow_the_distribution(spark):
    rows = [(i, "w", "en", "s", 1, "", 0) for i in range(6000)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), epochs=1.7)
    counts = collections.Counter(collections.Counter(r.doc_id for r in out.collect()).values())
    for k in range(1, 5):
        p = math.exp(-1.7) * 1.7**k / math.factorial(k)
        assert abs(counts[k] / 6000 - p) < 4 * math.sqrt(p / 6000)


def test_mixing_has_no_python(spark, tmp_path):
    spark.createDataFrame(mixed_rows(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op6_mixing(spark, str(tmp_path))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
