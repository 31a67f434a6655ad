import random
import zlib

import numpy as np
import pyarrow as pa

from loomseries.llm import langid, quality, words

DOCS = "doc_id long, text string, lang string, label double, turn long"
SYLLABLES = {
    "en": (["the", "and", "of", "in"], ["th", "er", "ing", "on"]), "de": (["der", "und", "die", "zu"], ["sch", "er", "ung", "ä"]),
    "fr": (["le", "et", "les", "que"], ["eau", "é", "tion", "ou"]), "es": (["el", "y", "los", "que"], ["ción", "a", "os", "ñ"]),
}


def prose(rng, lang, n):
    common, parts = SYLLABLES[lang]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)) + "."


def corpus(n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = prose(rng, lang, rng.randint(5, 120))
        bad = rng.random() < 0.3
        if bad:
            kind = rng.randrange(3)
            w = text.split()
            text = " ".join([x.upper() + "!!" for x in w] if kind == 0 else [x + rng.choice(["###", "$$$"]) for x in w] if kind == 1 else [x for x in w for _ in range(9)])
        rows.append((i, text, lang, 0.0, 1))
        labels.append((i, int(not bad)))
    return rows, labels


def test_quality_of_held_out_rows(spark):
    rows, labels = corpus(2000)
    labels += [(3, None), (None, 1), (5, labels[5][1]), (10**9, 1)]
    docs = spark.createDataFrame(rows + [(None, "the and", None, None, None), (10**6, "", None, None, None), (10**6, None, None, None, None)], DOCS)
    weights = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert np.array_equal(weights, quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int").repartition(3)))
    out = quality.score(docs, weights).collect()
    assert len(out) == len(rows) + 3
    truth = dict(labels[:2000])
    right = 0
    held = [r for r in out if r.doc_id in truth and r.held_out]
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    for r in held:
        right += r.predicted == truth[r.doc_id]
    assert len(held) > 80 and right / len(held) > 0.9
    empty = [r.score for r in out if r.doc_id == 10**6]
    assert len(empty) == 2 and empty[0] == empty[1]


def test_no_labels_no_rows(spark):
    nothing = spark.createDataFrame([], DOCS)
    weights = quality.train(nothing, spark.createDataFrame([], "doc_id long, quality int"))
    assert not weights.any()
    assert quality.score(nothing, weights).count() == 0
    assert quality.score(spark.createDataFrame([(1, "x", "", 0.0, 0)], DOCS), weights).first().score == 0.5


def test_features_by_hand():
    texts = ["Ab, ab! -- ab ab", "", "x", "Ab,"]
    (_, piece), = words.texts_of(pa.array(texts))
    owner, place, value = quality.features(piece)
    assert set(owner) == {0, 2, 3}
    norms = [np.sqrt((value[owner == i] ** 2).sum()) for i in (0, 2, 3)]
    assert np.allclose(norms, 1)
    # Ab , ab ! -- ab ab: six different tokens less one, and six pairs of which one is a repeated token.
    assert (owner == 0).sum() == 5 + 6 and (owner == 2).sum() == 1 and (owner == 3).sum() == 3


def test_languages_of_held_out_rows(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.train(docs, sample=100)
    assert set(model.machines) == {("family", "germanic", "romance"), ("lang", "de", "en"), ("lang", "es", "fr")}
    extra = [(10**6, None, None, None, None), (10**6 + 1, "123 !?", "en", 0.0, 0), (10**6 + 2, "", "fr", 0.0, 0), (None, "the and of", None, None, None)]
    out = langid.predict(spark.createDataFrame(rows + extra, DOCS), model).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert len(held) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id is not None and r.doc_id >= 10**6)
    assert [(r.lang_pred, r.held_out) for r in out if r.doc_id is None] == [("en", True)]
    assert all(0 <= r.score <= 1 for r in out)


def test_one_language_and_none(spark):
    rows = [(i, "the cat", "en", 0.0, 0) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()} == {"en"}
    none = langid.train(docs.where("lang = 'x'"))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, none).collect()} == {("und", 0.0)}
    assert langid.predict(docs.where("false"), none).count() == 0


def test_several_families_and_an_unknown_code(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["qaa", "qbb", "qcc"], k=20)), "qx", 0.0, 0) for i in range(60)]
    rows += [(100 + i, prose(rng, "en", 30), "en", 0.0, 0) for i in range(60)] + [(200 + i, " ".join(rng.choices(["кот", "дом"], k=9)), "ru", 0.0, 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    out = langid.predict(docs, langid.train(docs)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.98
