"""Candlestick patterns: one bit per pattern in a mask per bar.

All 26 conditions are columns of a single projection over one window stage;
a caller that wants one pattern filters on its bit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.series import CHUNK_ROWS, Series


@dataclass(frozen=True)
class CandleConfig:
    """The default thresholds, as shares of the average body or total length."""

    period: int = 10
    body_none: float = 0.05
    body_short: float = 0.5
    body_long: float = 1.4
    wick_none: float = 0.05
    wick_long: float = 0.6
    near: float = 0.3


class Bar:
    """Columns of the bar ``back`` rows ago."""

    def __init__(self, back: int):
        tail = str(back) if back else ""
        self.open, self.high, self.low, self.close = (F.col(n + tail) for n in ("open", "high", "low", "close"))

    @property
    def white(self):
        return self.open < self.close

    @property
    def black(self):
        return self.open > self.close

    @property
    def body(self):
        return F.abs(self.open - self.close)

    @property
    def top(self):
        return F.greatest(self.open, self.close)

    @property
    def bottom(self):
        return F.least(self.open, self.close)

    @property
    def upper(self):
        return self.high - self.top

    @property
    def lower(self):
        return self.bottom - self.low

    def opens_inside(self, other: "Bar"):
        return (self.open < other.top) & (self.open > other.bottom)


class Scene:
    """The current bar, the two before it, and the size tests the patterns are made of."""

    def __init__(self, config: CandleConfig):
        self.config = config
        self.now, self.last, self.first = Bar(0), Bar(1), Bar(2)
        self.avg_body, self.avg_total = F.col("avg_body"), F.col("avg_total")

    def tiny(self, bar):
        return bar.body < self.avg_total * F.lit(self.config.body_none)

    def small(self, bar):
        return bar.body < self.avg_body * F.lit(self.config.body_short)

    def big(self, bar):
        return bar.body > self.avg_body * F.lit(self.config.body_long)

    def bare(self, wick):
        return wick < self.avg_total * F.lit(self.config.wick_none)

    def long(self, wick):
        return wick > self.avg_body * F.lit(self.config.wick_long)

    @property
    def reach(self):
        return self.avg_total * F.lit(self.config.near)


@dataclass(frozen=True)
class Candle:
    name: str
    bit: int
    when: Callable[[Scene], Column]


CANDLES: dict[str, Candle] = {}


def _candle(name: str, when: Callable[[Scene], Column]) -> None:
    CANDLES[name] = Candle(name, len(CANDLES), when)


def _star_bear(s, middle, gap):
    return s.first.white & s.big(s.first) & middle & gap & s.now.black & (s.now.close <= s.first.close)


def _star_bull(s, middle, gap):
    return s.first.black & s.big(s.first) & middle & gap & s.now.white & (s.now.close >= s.first.close)


def _evening_gap(s):
    return (s.last.bottom >= s.first.top) & (s.now.top <= s.last.bottom)


def _morning_gap(s):
    return (s.last.top <= s.first.bottom) & (s.now.bottom >= s.last.top)


def _marubozu(s):
    return s.big(s.now) & s.bare(s.now.upper) & s.bare(s.now.lower)


def _hammer_shape(s):
    return s.small(s.now) & s.bare(s.now.upper) & s.long(s.now.lower)


def _inverted_shape(s):
    return s.small(s.now) & s.long(s.now.upper) & s.bare(s.now.lower)


# Fixed order: the position in this list is the pattern's bit.
_candle("abandoned_baby_bear", lambda s: _star_bear(
    s, s.tiny(s.last), (s.last.low >= s.first.high) & (s.now.high <= s.last.low)))
_candle("abandoned_baby_bull", lambda s: _star_bull(
    s, s.tiny(s.last), (s.last.high <= s.first.low) & (s.now.low >= s.last.high)))
_candle("big_black_candle", lambda s: s.now.black & s.big(s.now))
_candle("big_white_candle", lambda s: s.now.white & s.big(s.now))
_candle("black_marubozu", lambda s: _marubozu(s) & s.now.black)
_candle("doji", lambda s: s.tiny(s.now))
_candle("dragonfly_doji", lambda s: s.tiny(s.now) & s.bare(s.now.upper) & s.long(s.now.lower))
_candle("engulfing_bear", lambda s: s.now.black & s.last.white
        & (s.now.close < s.last.open) & (s.now.open > s.last.close))
_candle("engulfing_bull", lambda s: s.now.white & s.last.black
        & (s.now.close > s.last.open) & (s.now.open < s.last.close))
_candle("evening_doji_star", lambda s: _star_bear(s, s.tiny(s.last), _evening_gap(s)))
_candle("evening_star", lambda s: _star_bear(s, s.small(s.last), _evening_gap(s)))
_candle("four_price_doji", lambda s: s.tiny(s.now) & s.bare(s.now.upper) & s.bare(s.now.lower))
_candle("gravestone_doji", lambda s: s.tiny(s.now) & s.long(s.now.upper) & s.bare(s.now.lower))
_candle("hammer", lambda s: _hammer_shape(s) & (s.now.bottom <= s.last.low + s.reach))
_candle("hanging_man", lambda s: _hammer_shape(s) & (s.now.bottom >= s.last.high - s.reach))
_candle("inverted_hammer", lambda s: _inverted_shape(s) & (s.now.top <= s.last.bottom))
_candle("long_legged_doji", lambda s: s.tiny(s.now) & s.long(s.now.upper) & s.long(s.now.lower))
_candle("marubozu", _marubozu)
_candle("morning_doji_star", lambda s: _star_bull(s, s.tiny(s.last), _morning_gap(s)))
_candle("morning_star", lambda s: _star_bull(s, s.small(s.last), _morning_gap(s)))
_candle("shooting_star", lambda s: _inverted_shape(s) & (s.now.bottom >= s.last.top))
_candle("spinning_top", lambda s: s.small(s.now) & (s.now.upper > s.now.body) & (s.now.lower > s.now.body))
_candle("star", lambda s: (s.now.low >= s.last.high) | (s.now.high <= s.last.low))
_candle("three_black_crows", lambda s: s.first.black & s.last.black & s.now.black
        & s.last.opens_inside(s.first) & s.now.opens_inside(s.last))
_candle("three_white_soldiers", lambda s: s.first.white & s.last.white & s.now.white
        & s.last.opens_inside(s.first) & s.now.opens_inside(s.last))
_candle("white_marubozu", lambda s: _marubozu(s) & s.now.white)


def candle_count() -> int:
    return len(CANDLES)


def find_candle(name: str) -> Candle | None:
    return CANDLES.get(name)


def candle_of_mask(mask: int) -> Candle | None:
    """The pattern of the lowest set bit."""
    lowest = (mask & -mask).bit_length() - 1
    return next((k for k in CANDLES.values() if k.bit == lowest), None)


def candle_mask(
    df: DataFrame,
    patterns: Sequence[str] | None = None,
    config: CandleConfig = CandleConfig(),
    key: Sequence[str] = ("sym",),
    order: Sequence[str] = ("ts",),
    grain: int = 60_000_000,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Every bar past the first ``period`` of its key: key, order, ``rn`` and the bit mask of its patterns.

    Averages are over the ``period`` bars before the current one.
    """
    prices = ("open", "high", "low", "close")
    chosen = [CANDLES[n] for n in (patterns or CANDLES)]
    picked = df.select(*key, *order, *[F.col(n).cast("double") for n in prices])
    s = Series.of(picked, key, order, grain, chunk_rows).span(max(config.period, 2))
    lags = {f"{n}{k}": s.lag(n, k) for n in prices for k in (1, 2)}
    s = s.add(
        avg_body=F.avg(F.abs(F.col("open") - F.col("close"))).over(s.prev(config.period)),
        avg_total=F.avg(F.col("high") - F.col("low")).over(s.prev(config.period)),
        **lags,
    )
    scene = Scene(config)
    mask = F.lit(0).cast("long")
    for pattern in chosen:
        hit = F.when(pattern.when(scene), F.lit(1 << pattern.bit).cast("long")).otherwise(F.lit(0).cast("long"))
        mask = mask.bitwiseOR(hit)
    out = s.add(patterns=mask).owned().df
    return out.filter(F.col("rn") > config.period).select(*key, *order, "rn", "patterns")


def candle_hits(masks: DataFrame) -> DataFrame:
    """Only the bars where at least one pattern was found."""
    return masks.filter(F.col("patterns") != 0)


def candle_totals(masks: DataFrame) -> DataFrame:
    """Bars with a hit, and hits over all patterns."""
    return masks.agg(
        F.count_if(F.col("patterns") != 0).cast("long").alias("bars_hit"),
        F.coalesce(F.sum(F.bit_count("patterns")), F.lit(0)).cast("long").alias("pattern_hits"),
    )


def candle_histogram(masks: DataFrame) -> DataFrame:
    """Hits per pattern, zero for patterns never seen; one row per pattern."""
    counts = [F.count_if(F.col("patterns").bitwiseAND(F.lit(1 << k.bit)) != 0).alias(k.name) for k in CANDLES.values()]
    pairs = [F.struct(F.lit(n).alias("pattern"), F.col(n).cast("long").alias("hits")) for n in CANDLES]
    return masks.agg(*counts).select(F.inline(F.array(*pairs)))


def explode_patterns(masks: DataFrame) -> DataFrame:
    """One row per bar and pattern found."""
    names = F.array(*[F.lit(n) for n in CANDLES])
    spread = F.transform(names, lambda n, i: F.when(F.getbit("patterns", i) == 1, n))
    return masks.select("*", F.explode(F.array_compact(spread)).alias("pattern"))
