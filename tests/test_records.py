import hashlib
import json
import random
import zlib

from pyspark.sql import functions as F

from loomseries.functions import numbers as nm
from loomseries.functions import text as tx
from loomseries.operators import combine, vector
from loomseries.operators import records as rec
from loomseries.sources import files


def column(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


def test_classification(spark):
    want = {"My_Operation_Map": "operation_map", "function_doc x": "function_documentation", "test_coder": "test_coder",
            "c_code_validation": "validation", "nothing": "other", "validation operation_map": "operation_map"}
    df = spark.createDataFrame([(k,) for k in want], "v string").select("v", rec.classify_context(F.col("v")).alias("s"))
    assert {r.v: r.s for r in df.collect()} == want
    runs = [(False, False, "", "none"), (True, True, "Execution timed out", "compilation"), (False, True, "Execution timed out", "timeout"),
            (False, True, "x AddressSanitizer y", "memory"), (False, True, "Expected 1 But Got 2", "assertion"),
            (False, True, "Segmentation fault", "crash"), (False, True, "", "crash")]
    df = spark.createDataFrame(runs, "c boolean, r boolean, o string, want string")
    assert df.filter(rec.classify_failure(F.col("c"), F.col("r"), F.col("o")) != F.col("want")).isEmpty()


def test_names_and_predicates(spark):
    assert column(spark, "__a  b--c!", rec.safe_name) == "a_b_c"
    for pattern, value, want in [("sys.*", "sys.exit", True), ("sys.*", "sysxexit", False), ("panic", "panics", False), ("*x*", "axb", True)]:
        assert column(spark, value, lambda c: rec.wildcard(c, pattern)) is want
    for spec, value, want in [("all", "x", True), ("5+", "7", True), ("5+", "coverage", True), ("5+", "4", False),
                              ("3-7", "7", True), ("3-7", "info", False), ("1,info", "info", True), ("1,2", "12", False)]:
        assert column(spark, value, lambda c: rec.selected(c, spec)) is want
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("a", 9)], "n string, i long")
    assert {r.i: r.f for r in rec.with_suffix(df, "n", "i", 2, "f").collect()} == {1: "a", 2: "b", 3: "a_1", 9: "a_2"}
    assert column(spark, '{"a": 1, "z": 2}', lambda c: rec.unknown_keys(c, ["a"])) == ["z"]


def test_keyed_combinations(spark):
    old = spark.createDataFrame([("f", 1, "sig"), ("g", 2, "s2")], "name string, paths int, signature string")
    new = spark.createDataFrame([("f", None), ("h", 9)], "name string, paths int")
    got = {r.name: (r.signature, r.paths) for r in rec.upsert(old, new, "name", ["paths"]).collect()}
    assert got == {"f": ("sig", None), "g": ("s2", 2), "h": (None, 9)}
    names = spark.createDataFrame([("f",), ("x",)], "name string")
    catalog = spark.createDataFrame([("f", 1, "first"), ("f", 2, "last")], "name string, seq int, doc string")
    assert {r.name: r.doc for r in rec.latest_or_name(names, catalog, "name", "seq", ["doc"]).collect()} == {"f": "last", "x": None}
    assert rec.only_known(old, names.limit(0), "name", all_if_empty=True).count() == 2
    assert rec.only_known(old, names, "name").count() == 1
    a = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    assert rec.multiset_difference(a, a, ["v"]).isEmpty()
    assert rec.multiset_difference(a, a.distinct(), ["v"]).collect()[0].v == 1
    terms = rec.merge_terms(spark.createDataFrame([(2, 3), (1, 1)], "p int, c int"), spark.createDataFrame([(2, 4)], "p int, c int"), "p", "c")
    assert {r.p: r.c for r in terms.collect()} == {2: 7, 1: 1}


def test_validation_rollup(spark):
    rows = [("none", 0, "PASS"), ("crash", 2, "PASS"), ("memory", 3, "FAIL"), ("none", 0, "FAIL")]
    info = spark.createDataFrame(rows, "initial_failure_type string, total_iterations long, final_status string")
    assert tuple(rec.validation_summary(info).first()) == (4, 2, 2, 2, 1, 1)
    assert {r.failure_type: r.repaired for r in rec.repairs_by_failure(info).collect()} == {
        "compilation": 0, "assertion": 0, "crash": 1, "memory": 0, "timeout": 0}


def test_words(spark):
    assert column(spark, "Don't stop-now- it's", tx.words) == ["don't", "stop-now", "it's"]
    assert column(spark, "a'-b x--y é9z'", tx.words) == ["a'", "b", "x", "y", "z'"]
    assert column(spark, "COLIN", tx.letter_score) == 53
    assert column(spark, "abc", lambda c: tx.partial_match(c, "a.c")) and not column(spark, "abcd", lambda c: tx.partial_match(c, "a.c"))
    for word, want in [("there", True), ("thexx", True), ("thxxx", False), ("the", True), ("therexy", True), ("therexyz", False)]:
        assert column(spark, word, lambda c: tx.near_match(c, "there", 2)) is want
    assert column(spark, '"A","B b",""', tx.quoted_names) == ["A", "B b", ""]
    assert column(spark, ' ```json\n{"a":1}\n``` ', tx.strip_fence) == '{"a":1}'
    assert column(spark, 'so: {"a": {"b": 2}} ok', tx.outer_braces) == '{"a": {"b": 2}}'
    assert column(spark, "{broken", tx.outer_braces) is None
    text = "".join(map(chr, range(32, 127))) + "é\n"
    assert column(spark, text, lambda c: tx.affine_decrypt(tx.affine_encrypt(c, 7, 20), 7, 20)) == text
    assert column(spark, " ", lambda c: tx.affine_encrypt(c, 7, 20)) == "4"


def test_lcs(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abc", k=rng.randrange(8))), "".join(rng.choices("abc", k=rng.randrange(8)))) for _ in range(40)]

    def slow(a, b):
        if not a or not b:
            return 0
        return slow(a[1:], b[1:]) + 1 if a[0] == b[0] else max(slow(a[1:], b), slow(a, b[1:]))

    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", tx.lcs_length("a", "b").alias("n")).collect():
        assert r.n == slow(r.a, r.b)


def test_numbers(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 6, 12, 97, 360, 9973, 10**6)], "n long").select(
        "n", nm.divisors(F.col("n")).alias("d"), nm.prime_factors(F.col("n")).alias("f"), nm.to_base(F.col("n"), "01").alias("b"))
    for r in df.collect():
        assert r.d == [k for k in range(1, r.n + 1) if r.n % k == 0]
        product = 1
        for p in r.f or []:
            product *= p
            assert all(p % q for q in range(2, int(p**0.5) + 1))
        assert product == r.n and r.b == f"{r.n:b}"
    got = nm.sum_of_abundant(spark.createDataFrame([(n,) for n in (23, 24, 25, 20161, 28124)], "n long"), "n")
    assert [r.is_sum for r in got.orderBy("n").collect()] == [False, True, False, False, True]


def test_codes(spark):
    df = spark.range(-32768, 32768).select(F.col("id").cast("int").alias("pcm"))
    df = df.withColumn("code", nm.alaw_encode(F.col("pcm"))).withColumn("back", nm.alaw_decode(F.col("code")))
    step = F.greatest(F.lit(16), F.shiftright(F.abs("pcm"), 4))
    assert df.filter(F.abs(F.col("pcm") - F.col("back")) > step).isEmpty()
    assert df.filter("pcm = 0").first().code == 0xD5
    assert df.filter("pcm = -32768").first().code == 0x2A
    text = spark.createDataFrame([("abc",)], "t string").select(nm.crc32(F.col("t")), nm.blake2b("t")).first()
    assert text[0] == zlib.crc32(b"abc") and text[1] == hashlib.blake2b(b"abc").hexdigest()


def test_combine_and_retry(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 8)] + [("b", 5.0)], "k string, v double").repartition(4)
    out = combine.fold_aggregate(df, "k", "v", lambda x, y: x * y, 1.0, "product")
    assert {r.k: r["product"] for r in out.collect()} == {"a": 5040.0, "b": 5.0}

    def call(value):
        if value == "bad":
            raise ValueError(value)
        return value.upper()

    rows = spark.createDataFrame([("ok",), ("bad",)], "v string")
    assert {r.v: r.r for r in combine.call_rows(rows, "v", call, "r", first_wait=0.01).collect()} == {"ok": "OK", "bad": None}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, []), (5, None), (6, [0.0, 0.0])], "i long, e array<double>")
    out = vector.nearest(df, "e", "i", [2.0, 0.0], 2).collect()
    assert [r.i for r in out] == [1, 3] and abs(out[1].cosine - 0.5**0.5) < 1e-12


def test_files(spark, tmp_path):
    for name in ("s1/a.c", "s1/test_a.c", "s2/src/b.c", "s2/src/test.c", "s2/readme.txt"):
        path = tmp_path / "c" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"int {name[-3]};\n")
    found = files.subject_sources(files.read_sources(spark, str(tmp_path / "c")))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.c", "b.c"]

    log = tmp_path / "log"
    log.mkdir()
    calls = [{"timestamp": "t", "context": "test_coder", "model": "m", "request": {"messages": [{"role": "user", "content": "x"}]},
              "response": {"content": "y", "usage": {"prompt_tokens": 3, "completion_tokens": 1, "total_tokens": 4, "extra": {"z": 1}}}},
             {"context": "other", "request": {"provider": "p"}, "response": {"usage": {"prompt_tokens": 5}}}]
    for i, call in enumerate(calls):
        (log / f"{i}.json").write_text(json.dumps(call, indent=1))
    df = files.read_call_log(spark, str(log))
    assert df.agg(F.sum("response.usage.prompt_tokens")).first()[0] == 8
    assert {r.model: (r.calls, r.prompt_tokens) for r in rec.usage_by_model(df).collect()} == {"m": (1, 3), None: (1, 5)}
    files.append_call_log(df, str(tmp_path / "out"))
    files.append_call_log(df, str(tmp_path / "out"))
    assert files.read_call_log(spark, str(tmp_path / "out")).count() == 4

    rows = spark.createDataFrame([([1.0, 123456.0, 0.00012346, 0.0, 10.5, 200000.0],)], "v array<double>")
    files.write_matrix(rows, "v", str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == "1,1.235e+05,0.0001235,0,10.5,2e+05"
    counts = spark.createDataFrame([("s", 3)], "subject string, path_count long")
    files.write_counts(counts, str(tmp_path / "n"))
    assert spark.read.csv(str(tmp_path / "n"), header=True).first().path_count == "3"
    lines = spark.createDataFrame([(i, f"No. {i}") for i in range(20, 0, -1)], "no long, line string")
    files.write_report(lines, str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == [f"No. {i}" for i in range(1, 21)]


def test_catalog_entries(spark):
    entry = "array<struct<name:string,kind:string>>"
    df = spark.createDataFrame(
        [([("a", "x")], [("a", "x"), ("b", "y")], {"m.c": [("c", "z")]})],
        f"all_functions {entry}, functions {entry}, source_files map<string,{entry}>")
    assert sorted(r.name for r in rec.catalog_entries(df).collect()) == ["a", "a", "b", "c"]


def test_fill_nulls(spark):
    df = spark.createDataFrame(
        [((None, None, [(None, 1)], None),)], "r struct<a:string,b:array<int>,c:array<struct<d:string,e:int>>,f:struct<g:string>>")
    r = df.select(rec.fill_nulls(F.col("r"), df.schema["r"].dataType).alias("r")).first().r
    assert r.a == "" and r.b == [] and r.c[0].d == "" and r.c[0].e == 1 and r.f is None
