import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key long, `a.b` int"
TEXT = "once more the same text with some words"


def test_one_of_each_group_stays(spark, tmp_path):
    other = "quite another text that is like nothing else"
    rows = [(5, TEXT), (5, TEXT), (5, other), (5, ""), (None, other), (None, "no id here at all but a text"), (None, "no id here at all but a text"),
            (7, "a text of a document with an id"), (None, "A text of a document with an id"), (8, None), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "a", 1, 2, 3) for d, t in rows], COLUMNS)
    for name in ("line_dedup", "near_dedup"):
        docs.write.parquet(str(tmp_path / name))
        docs = dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(str(tmp_path / name)), str(tmp_path))
        assert docs.columns == [c.split()[0].strip("`") for c in COLUMNS.split(", ")]
    found = [(r.doc_id, r.text) for r in docs.collect()]
    texts = sorted(t.lower() for _, t in found if t)
    assert texts == sorted([TEXT, other, "no id here at all but a text", "a text of a document with an id"])
    assert sorted((t is None, d) for d, t in found if not t) == [(False, 5), (False, 9), (True, 8)]
