"""Candlestick queries over hourly bars: one per pattern, the mask, and its summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.candles import (
    CANDLES,
    candle_histogram,
    candle_hits,
    candle_mask,
    candle_totals,
    explode_patterns,
)
from .series_sql import BAR_SQL, ORD, prev
from .tables import BAR_GRAIN, bars

# Conditions per pattern, in bit order. The suffix 1 or 2 means
# one or two bars back; tiny, small and big compare a body with the averages,
# bare and long compare a wick with them.
CONDITIONS = {
    "abandoned_baby_bear": "o2 < c2 AND big2 AND l1 >= h2 AND tiny1 AND o > c AND h <= l1 AND c <= c2",
    "abandoned_baby_bull": "o2 > c2 AND big2 AND h1 <= l2 AND tiny1 AND o < c AND l >= h1 AND c >= c2",
    "big_black_candle": "o > c AND big",
    "big_white_candle": "o < c AND big",
    "black_marubozu": "big AND bare_up AND bare_lo AND o > c",
    "doji": "tiny",
    "dragonfly_doji": "tiny AND bare_up AND long_lo",
    "engulfing_bear": "o > c AND o1 < c1 AND c < o1 AND o > c1",
    "engulfing_bull": "o < c AND o1 > c1 AND c > o1 AND o < c1",
    "evening_doji_star": "o2 < c2 AND big2 AND bot1 >= top2 AND tiny1 AND o > c AND top <= bot1 AND c <= c2",
    "evening_star": "o2 < c2 AND big2 AND bot1 >= top2 AND small1 AND o > c AND top <= bot1 AND c <= c2",
    "four_price_doji": "tiny AND bare_up AND bare_lo",
    "gravestone_doji": "tiny AND long_up AND bare_lo",
    "hammer": "small AND bare_up AND long_lo AND bot <= l1 + 0.3 * av",
    "hanging_man": "small AND bare_up AND long_lo AND bot >= h1 - 0.3 * av",
    "inverted_hammer": "small AND long_up AND bare_lo AND top <= bot1",
    "long_legged_doji": "tiny AND long_up AND long_lo",
    "marubozu": "big AND bare_up AND bare_lo",
    "morning_doji_star": "o2 > c2 AND big2 AND top1 <= bot2 AND tiny1 AND o < c AND bot >= top1 AND c >= c2",
    "morning_star": "o2 > c2 AND big2 AND top1 <= bot2 AND small1 AND o < c AND bot >= top1 AND c >= c2",
    "shooting_star": "small AND long_up AND bare_lo AND bot >= top1",
    "spinning_top": "small AND h - top > body AND bot - l > body",
    "star": "l >= h1 OR h <= l1",
    "three_black_crows": "o2 > c2 AND o1 > c1 AND o > c AND o1 < top2 AND o1 > bot2 AND o < top1 AND o > bot1",
    "three_white_soldiers": "o2 < c2 AND o1 < c1 AND o < c AND o1 < top2 AND o1 > bot2 AND o < top1 AND o > bot1",
    "white_marubozu": "big AND bare_up AND bare_lo AND o < c",
}


def _base_sql() -> str:
    flags = []
    for b in ("", "1", "2"):
        body = f"abs(o{b} - c{b})"
        flags += [
            f"greatest(o{b}, c{b}) AS top{b}", f"least(o{b}, c{b}) AS bot{b}",
            f"{body} < 0.05 * av AS tiny{b}", f"{body} < 0.5 * ab AS small{b}", f"{body} > 1.4 * ab AS big{b}",
        ]
    lags = [f"lag({full}, {n}) {ORD} AS {x}{n}"
            for x, full in zip("ohlc", ("open", "high", "low", "close")) for n in (1, 2)]
    return f"""WITH {BAR_SQL.format(unit="hour")},
k0 AS (SELECT sym, ts, rn, open AS o, high AS h, low AS l, close AS c, {", ".join(lags)},
         avg(abs(open - close)) {prev(10)} AS ab, avg(high - low) {prev(10)} AS av FROM s0),
k1 AS (SELECT *, abs(o - c) AS body, {", ".join(flags)} FROM k0 WHERE rn > 10),
k AS (SELECT *, h - top < 0.05 * av AS bare_up, bot - l < 0.05 * av AS bare_lo,
         h - top > 0.6 * ab AS long_up, bot - l > 0.6 * ab AS long_lo FROM k1),
m AS (SELECT sym, ts, rn, CAST({" + ".join(f"CASE WHEN {x} THEN {1 << i} ELSE 0 END" for i, x in enumerate(CONDITIONS.values()))} AS BIGINT)
         AS patterns FROM k)
"""


def _masks(spark, sf_dir, patterns=None):
    return candle_mask(bars(spark, sf_dir), patterns, grain=BAR_GRAIN)


def queries() -> dict:
    def one(name):
        return lambda spark, sf_dir: candle_hits(_masks(spark, sf_dir, [name])).select("sym", "ts")

    table = {f"candle_{name}": one(name) for name in CANDLES}
    table["candles_mask"] = lambda spark, d: candle_hits(_masks(spark, d)).select("sym", "ts", "rn", "patterns")
    table["candles_totals"] = lambda spark, d: candle_totals(_masks(spark, d))
    table["candles_histogram"] = lambda spark, d: candle_histogram(_masks(spark, d))
    table["candles_exploded"] = lambda spark, d: explode_patterns(candle_hits(_masks(spark, d))).select(
        "sym", "ts", "pattern")
    table["candles_lowest_pattern"] = _lowest_pattern
    table["candles_nth_hit"] = _nth_hit
    table["candles_at_bar"] = lambda spark, d: _masks(spark, d).filter("rn = 100").select("sym", "ts", "patterns")
    return table


def _lowest_pattern(spark, sf_dir):
    """The pattern of the lowest set bit of each hit."""
    names = F.array(*[F.lit(n) for n in CANDLES])
    bit = F.log2(F.col("patterns").bitwiseAND(-F.col("patterns"))).cast("int")
    return candle_hits(_masks(spark, sf_dir)).select("sym", "ts", F.get(names, bit).alias("pattern"))


def _nth_hit(spark, sf_dir, n: int = 50):
    """The n-th bar with a hit of each key: hits are few, and only their numbers are compared."""
    from ..plans.numbering import number_rows

    hits = candle_hits(_masks(spark, sf_dir)).select("sym", "ts", "patterns")
    return number_rows(hits, ["sym"], ["ts"], BAR_GRAIN, "hit").filter(F.col("hit") == n)


def oracle_sql() -> dict[str, str]:
    base = _base_sql()
    table = {
        f"candle_{name}": f"{base} SELECT sym, ts FROM m WHERE (patterns & {1 << i}) <> 0"
        for i, name in enumerate(CONDITIONS)
    }
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(CONDITIONS))
    listed = f"(VALUES {names}) AS p(bit, pattern)"
    table["candles_mask"] = f"{base} SELECT sym, ts, rn, patterns FROM m WHERE patterns <> 0"
    table["candles_totals"] = f"""{base} SELECT count(*) FILTER (patterns <> 0) AS bars_hit,
        CAST(sum(bit_count(patterns)) AS BIGINT) AS pattern_hits FROM m"""
    table["candles_histogram"] = f"""{base} SELECT pattern, count(sym) AS hits
        FROM {listed} LEFT JOIN m ON (patterns >> bit) & 1 = 1 GROUP BY pattern"""
    table["candles_exploded"] = f"{base} SELECT sym, ts, pattern FROM m JOIN {listed} ON (patterns >> bit) & 1 = 1"
    table["candles_lowest_pattern"] = f"""{base} SELECT sym, ts, arg_min(pattern, bit) AS pattern
        FROM m JOIN {listed} ON (patterns >> bit) & 1 = 1 GROUP BY sym, ts"""
    table["candles_nth_hit"] = f"""{base} SELECT sym, ts, patterns, hit FROM (
        SELECT *, row_number() OVER (PARTITION BY sym ORDER BY ts) AS hit FROM m WHERE patterns <> 0) WHERE hit = 50"""
    table["candles_at_bar"] = f"{base} SELECT sym, ts, patterns FROM m WHERE rn = 100"
    return table
