"""Indicators cut into short chunks against SQL over whole keys."""

import numpy as np
import pytest

from conftest import same
from loomseries.operators.candles import CANDLES, candle_mask, candle_of_mask
from loomseries.operators.indicators import REGISTRY, compute, find_indicator, indicator_count, warm_up
from loomseries.queries.candle_queries import CONDITIONS, _base_sql
from loomseries.queries.indicator_queries import case_sql, run_case
from loomseries.queries.tables import BAR_GRAIN, bars

SOME_FRAMES = ["sma", "hma", "msw", "aroon", "stoch", "cci", "ultosc", "fosc"]
CHUNKED = [n for n, i in REGISTRY.items() if i.family in "RC"] + SOME_FRAMES + ["tr", "crossany"]


@pytest.mark.parametrize("name", CHUNKED)
def test_chunked_equals_sql(spark, small_dir, duck, name):
    # 40 rows hold the deepest frame in use; the dominant type needs several chunks.
    same(run_case(spark, small_dir, name, chunk_rows=40), duck.execute(case_sql(name)))


def test_candles_chunked(spark, small_dir, duck):
    masks = candle_mask(bars(spark, small_dir, "day"), grain=BAR_GRAIN, chunk_rows=11)
    sql = _base_sql().replace("date_trunc('hour'", "date_trunc('day'")
    same(masks, duck.execute(f"{sql} SELECT sym, ts, rn, patterns FROM m"))


def test_registry():
    assert indicator_count() == 104
    assert len(CANDLES) == 26 and list(CANDLES) == list(CONDITIONS)
    assert {f: sum(i.family == f for i in REGISTRY.values()) for f in "PLWCR"} == {"P": 30, "L": 8, "W": 33, "C": 3, "R": 30}
    assert find_indicator("nothing") is None
    assert warm_up("adxr", 5) == 12 and warm_up("hma", 9) == 10 and warm_up("zlema", 5) == 1
    assert candle_of_mask(0b101000).name == "big_white_candle"


@pytest.mark.parametrize("name,options", [
    ("sma", [0]), ("dpo", [2]), ("zlema", [2]), ("hma", [1]), ("macd", [5, 3, 2]), ("psar", [0.2, 0.1]),
    ("adx", [1]), ("vidya", [2, 5, 1.5]), ("decay", [0]), ("ultosc", [3, 2, 5]),
])
def test_invalid_options(spark, small_dir, name, options):
    with pytest.raises(ValueError):
        compute(name, bars(spark, small_dir), options)


def _series(spark, values):
    rows = [("a", i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sym string, t long, real double")


def test_short_and_constant_series(spark):
    def run(name, values, *options):
        out = compute(name, _series(spark, values), options, order=["t"], grain=4, chunk_rows=8)
        return [r[-1] for r in out.orderBy("t").collect()]

    assert run("sma", [1, 2, 3], 5) == []
    assert run("sma", [1, 2, 3, 4, 6], 5) == [3.2]
    assert run("rsi", [5] * 7, 5) == [None, None]  # 0/0 at the seed, and from there on
    assert run("stddev", [5] * 6, 5) == [0.0, 0.0]
    assert run("cmo", [5] * 7, 5) == [None, None]
    assert run("rsi", range(8), 5) == [100.0] * 3
    assert run("kama", [7] * 12, 5) == [7.0] * 8
    assert run("round", [-2.5, 2.5, 0.49]) == [-2.0, 3.0, 0.0]
    assert run("trunc", [-2.7, 2.7, 1e300]) == [-2.0, 2.0, 1e300]
    assert run("lag", [1, 2, 3], 0) == [1.0, 2.0, 3.0]


def test_macd_special_weights(spark):
    values = np.random.default_rng(1).uniform(1, 9, 60)
    out = compute("macd", _series(spark, values), [12, 26, 9], order=["t"], grain=8, chunk_rows=16)
    fast = slow = values[0]
    want = []
    for i, v in enumerate(values):
        if i:
            fast, slow = fast + (v - fast) * 0.15, slow + (v - slow) * 0.075
        want.append(fast - slow)
    got = [r["macd"] for r in out.orderBy("t").collect()]
    np.testing.assert_allclose(got, want[25:], rtol=1e-9)


def test_twins(spark):
    """max, min and atr against plain loops."""
    rng = np.random.default_rng(3)
    low = rng.uniform(1, 5, 70)
    rows = [("a", i, float(x + rng.uniform(0, 2)), float(x), float(x + 0.5)) for i, x in enumerate(low)]
    df = spark.createDataFrame(rows, "sym string, t long, high double, low double, close double")
    args = dict(order=["t"], grain=8, chunk_rows=9)
    top = [r["max"] for r in compute("max", df, [5], inputs={"real": "high"}, **args).orderBy("t").collect()]
    assert top == [max(r[2] for r in rows[i - 4 : i + 1]) for i in range(4, 70)]
    bottom = [r["min"] for r in compute("min", df, [5], inputs={"real": "low"}, **args).orderBy("t").collect()]
    assert bottom == [min(r[3] for r in rows[i - 4 : i + 1]) for i in range(4, 70)]
    ranges = [rows[0][2] - rows[0][3]] + [
        max(b[2] - b[3], abs(b[2] - a[4]), abs(b[3] - a[4])) for a, b in zip(rows, rows[1:])]
    value, want = sum(ranges[:5]) / 5, []
    for i in range(4, 70):
        value = value if i == 4 else value + (ranges[i] - value) / 5
        want.append(value)
    got = [r["atr"] for r in compute("atr", df, [5], **args).orderBy("t").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-9)
