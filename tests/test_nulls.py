"""Rows with NULL keys, NULL order values, empty partitions and folder tables stay whole."""

import math

import duckdb
import pandas as pd
import pytest

from loomseries.functions import numbers as nm
from loomseries.operators import combine, intervals, records, stats, vector
from loomseries.operators.indicators import compute
from loomseries.plans.numbering import number_rows
from loomseries.plans.series import Series
from loomseries.queries import stream_queries

SCHEMA = "sym string, ts long, real double"


def series_rows():
    rows = []
    for key in ("a", None, "b"):
        rows += [(key, i * 7 if i else None, float((i * i) % 23) + (0.5 if key else 0.0)) for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    db.register("t", pd.DataFrame(series_rows(), columns=["sym", "ts", "real"]).astype({"ts": "Int64"}))
    return db


W = "(PARTITION BY sym ORDER BY ts NULLS FIRST"


def plain(rows):
    key = [tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(key, key=repr)


def test_numbers_count_null_keys_and_null_orders(spark, sql):
    df = spark.createDataFrame(series_rows(), SCHEMA)
    got = number_rows(df, ["sym"], ["ts"], 50).select("sym", "ts", "rn").collect()
    assert plain(got) == plain(sql.execute(f"SELECT sym, ts, row_number() OVER {W}) FROM t").fetchall())


def test_running_values_of_null_keys(spark, sql):
    s = Series.of(spark.createDataFrame(series_rows(), SCHEMA), ["sym"], ["ts"], 50, chunk_rows=16)
    got = s.running_sum(total=s.df["real"]).df.select("sym", "ts", "total").collect()
    assert plain(got) == plain(sql.execute(f"SELECT sym, ts, sum(real) OVER {W} ROWS UNBOUNDED PRECEDING) FROM t").fetchall())
    got = stats.running_stats(s, "real").df.select("sym", "ts", "mean").collect()
    assert plain(got) == plain(sql.execute(f"SELECT sym, ts, avg(real) OVER {W} ROWS UNBOUNDED PRECEDING) FROM t").fetchall())


@pytest.mark.parametrize("period", [5, 40])
def test_frames_longer_than_a_chunk(spark, sql, period):
    s = Series.of(spark.createDataFrame(series_rows(), SCHEMA), ["sym"], ["ts"], 50, chunk_rows=16)
    from pyspark.sql import functions as F

    s = s.span(period - 1)
    got = s.add(m=F.sum("real").over(s.trail(period))).owned().df.select("sym", "ts", "m").collect()
    assert plain(got) == plain(sql.execute(f"SELECT sym, ts, sum(real) OVER {W} ROWS {period - 1} PRECEDING) FROM t").fetchall())


@pytest.mark.parametrize("name, options", [("ema", [5]), ("sma", [5]), ("obv", None), ("psar", [0.02, 0.2]), ("kama", [5])])
def test_indicators_keep_null_keys(spark, name, options):
    rows = [(k, i, 10 + math.sin(i), 11 + math.sin(i), 9 + math.sin(i), 5.0 + i % 3) for k in (None, "a") for i in range(80)]
    df = spark.createDataFrame(rows, "sym string, ts long, close double, high double, low double, volume double")
    inputs = {"real": "close"} if name in ("ema", "sma", "kama") else None
    kwargs = {"inputs": inputs} if inputs else {}
    out = compute(name, df, options or [], key=["sym"], order=["ts"], grain=50, **kwargs).collect()
    got = [[tuple(r)[1:] for r in out if r.sym == k] for k in (None, "a")]
    assert len(got[0]) > 40 and sorted(got[0]) == sorted(got[1])


def test_asof_keeps_left_rows_and_the_order_of_ids(spark):
    left = spark.createDataFrame([(None, 5, 1), ("k", None, 2), ("k", 9, 3), ("none", 9, 4)], "k string, at long, id long")
    right = spark.createDataFrame([(None, 4, 7, 1.0), ("k", 8, 9, 2.0), ("k", 8, 10, 3.0)], "k string, at long, id long, x double")
    out = intervals.asof_last(left, right, ["k"], "at", "id", ["x"], 100)
    assert sorted((r.id, r.x) for r in out.collect()) == [(1, 1.0), (2, None), (3, 3.0), (4, None)]


def test_suffixes_of_rows_without_a_name(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), (None, 3), (None, 4)], "name string, no long")
    assert records.with_suffix(df, "name", "no", 100, "out").count() == 4


def test_combine_of_empty_partitions_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, 4.0)], "k string, x double").repartition(9)
    out = {r.k: r.top for r in combine.fold_aggregate(df, "k", "x", max, float("-inf"), "top").collect()}
    assert out == {"a": 1.0, "b": None, None: 4.0}


def test_ranges_below_zero_and_without_rows(spark):
    data = spark.createDataFrame([(-2, 5.0), (-1, 1.0), (0, 2.0), (3, 7.0), (70, 1.5)], "p long, v double")
    ask = spark.createDataFrame([(1, 0, 3), (2, -2, 0), (3, 10, 20), (4, -100, 100), (5, 5, 1)], "id long, a long, b long")
    out = {r.id: (r.min_value, r.max_value, r.sum_value) for r in stats.range_aggregate(data, "p", "v", ask, "id", "a", "b").collect()}
    assert out == {1: (2.0, 7.0, 9.0), 2: (1.0, 5.0, 8.0), 3: (None, None, 0.0), 4: (1.0, 7.0, 16.5), 5: (None, None, 0.0)}


def test_numbers_near_the_largest(spark):
    big = [2**63 - 1, 9_007_199_254_740_881, 94_906_249**2, 2, 1, 12, 999_983 * 1_000_003, 0]
    df = spark.createDataFrame([(n,) for n in big], "n long")
    rows = df.select("n", nm.to_base(df.n, "0123456789abcdef").alias("h"), nm.prime_factors(df.n).alias("f"), nm.divisors(df.n).alias("d")).collect()
    for r in rows:
        assert r.h == f"{r.n:x}"
        if r.n >= 2:
            assert math.prod(r.f) == r.n and r.f == sorted(r.f)
            assert r.d[0] == 1 and r.d[-1] == r.n and all(r.n % d == 0 for d in r.d) and len(set(r.d)) == len(r.d)
    found = {r.n: (r.f, r.d) for r in rows}
    assert found[2**63 - 1][0] == [7, 7, 73, 127, 337, 92737, 649657] and found[12][1] == [1, 2, 3, 4, 6, 12] and found[0] == (None, None)


def test_zero_query_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    assert vector.nearest(df, "v", "id", [0.0, 0.0], 3).count() == 0
    assert vector.nearest(df, "v", "id", [], 3).count() == 0


def test_streams_read_folder_tables(spark, small_dir, tmp_path):
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    for query in (stream_queries.stream_sma, stream_queries.stream_progress):
        lone, folder = query(spark, small_dir), query(spark, str(tmp_path))
        assert plain(folder.collect()) == plain(lone.collect()) and folder.count() > 0


def test_common_subsequences(spark):
    from loomseries.functions import text as tx

    def table(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                rows[i][j] = rows[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(rows[i - 1][j], rows[i][j - 1])
        i, j, out = len(a), len(b), ""
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j, out = i - 1, j - 1, a[i - 1] + out
            elif rows[i - 1][j] < rows[i][j - 1]:
                j -= 1
            else:
                i -= 1
        return rows[-1][-1], out

    pairs = [("ACGTTA", "TACGAT"), ("", "a"), ("é🙂x", "🙂éx"), ("abcbdab", "bdcaba"), ("same", "same"), ("abc", "xyz"), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", tx.lcs_length("a", "b").alias("n"), tx.lcs_text("a", "b").alias("t")).collect():
        assert (r.n, r.t) == ((None, None) if r.a is None else table(r.a, r.b))
