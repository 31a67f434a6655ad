"""Families W and C: finite trailing frames and running totals.

A builder first asks for a halo as deep as its frames reach together, so all
its windows share one shuffle on (key, chunk) and one sort on the row number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.series import Series, c, fir, ratio
from .registry import indicator

PERIOD = "period"


def _last_of_frame(p):
    return int(p) - 1


def _after_frame(p):
    return int(p)


def _ordered(*periods):
    """Periods are at least 1 and do not decrease."""
    return periods[0] >= 1 and all(b >= a for a, b in zip(periods, periods[1:]))


# -- plain means and sums ------------------------------------------------
@indicator("sma", "Simple Moving Average", "overlay", "W", "real", "sma", PERIOD, _last_of_frame)
def sma(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1)
    return s.add(sma=F.avg("real").over(s.trail(p)))


@indicator("sum", "Sum Over Period", "math", "W", "real", "sum", PERIOD, _last_of_frame)
def sum_(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1)
    return s.add(sum=F.sum("real").over(s.trail(p)))


@indicator("max", "Maximum In Period", "math", "W", "real", "max", PERIOD, _last_of_frame)
def max_(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1)
    return s.add(max=F.max("real").over(s.trail(p)))


@indicator("min", "Minimum In Period", "math", "W", "real", "min", PERIOD, _last_of_frame)
def min_(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1)
    return s.add(min=F.min("real").over(s.trail(p)))


@indicator("ao", "Awesome Oscillator", "indicator", "W", "high low", "ao", start=33)
def ao(s: Series) -> Series:
    s = s.span(33).add(mid=(c.high + c.low) * F.lit(0.5))
    return s.add(ao=F.avg("mid").over(s.trail(5)) - F.avg("mid").over(s.trail(34)))


@indicator("qstick", "Qstick", "indicator", "W", "open close", "qstick", PERIOD, _last_of_frame)
def qstick(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1)
    return s.add(qstick=F.avg(c.close - c.open).over(s.trail(p)))


@indicator("dpo", "Detrended Price Oscillator", "indicator", "W", "real", "dpo", PERIOD, _last_of_frame,
           lambda p: p >= 3)
def dpo(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p)
    return s.add(dpo=s.lag("real", p // 2 + 1) - F.avg("real").over(s.trail(p)))


@indicator("vosc", "Volume Oscillator", "indicator", "W", "volume", "vosc", "short_period long_period",
           lambda a, b: int(b) - 1, _ordered)
def vosc(s: Series, short, long) -> Series:
    s = s.span(int(long) - 1)
    slow = F.avg("volume").over(s.trail(int(long)))
    return s.add(vosc=ratio(F.lit(100.0) * (F.avg("volume").over(s.trail(int(short))) - slow), slow))


@indicator("vwma", "Volume Weighted Moving Average", "overlay", "W", "close volume", "vwma", PERIOD, _last_of_frame)
def vwma(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1)
    return s.add(vwma=ratio(F.sum(c.close * c.volume).over(s.trail(p)), F.sum("volume").over(s.trail(p))))


# -- fixed weights -------------------------------------------------------
def linear_weights(p: int) -> list[float]:
    return [(k + 1) / (p * (p + 1) / 2) for k in range(p)]


def triangle_weights(p: int) -> list[float]:
    rising = [min(k + 1, p - k) for k in range(p)]
    return [r / sum(rising) for r in rising]


def line_weights(p: int, at: float | None) -> list[float]:
    """Weights of the least-squares line over x = 1..p: its value at ``at``, or its slope for None."""
    mean = (p + 1) / 2
    spread = sum((x - mean) ** 2 for x in range(1, p + 1))
    slope = [(x - mean) / spread if spread else 0.0 for x in range(1, p + 1)]
    return slope if at is None else [1 / p + w * (at - mean) for w in slope]


def _weighted(name, full_name, kind, weights, check=None):
    def build(s: Series, period) -> Series:
        p = int(period)
        s = s.span(p - 1)
        return s.add(**{name: fir(s, "real", weights(p))})

    indicator(name, full_name, kind, "W", "real", name, PERIOD, _last_of_frame, check)(build)


def _line_needs(p):
    return p >= 2  # one point has no line


_weighted("wma", "Weighted Moving Average", "overlay", linear_weights)
_weighted("trima", "Triangular Moving Average", "overlay", triangle_weights)
_weighted("linreg", "Linear Regression", "overlay", lambda p: line_weights(p, p), _line_needs)
_weighted("linregintercept", "Linear Regression Intercept", "indicator", lambda p: line_weights(p, 1), _line_needs)
_weighted("linregslope", "Linear Regression Slope", "indicator", lambda p: line_weights(p, None), _line_needs)
_weighted("tsf", "Time Series Forecast", "overlay", lambda p: line_weights(p, p + 1), _line_needs)


@indicator("fosc", "Forecast Oscillator", "indicator", "W", "real", "fosc", PERIOD, _after_frame, _line_needs)
def fosc(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p)
    s = s.add(forecast=fir(s, "real", line_weights(p, p + 1)))
    return s.add(fosc=ratio(F.lit(100.0) * (c.real - s.lag("forecast")), c.real))


@indicator("hma", "Hull Moving Average", "overlay", "W", "real", "hma", PERIOD,
           lambda p: int(p) + math.isqrt(int(p)) - 2, lambda p: p >= 2)
def hma(s: Series, period) -> Series:
    p, root = int(period), math.isqrt(int(period))
    s = s.span(p + root - 2)
    half = fir(s, "real", linear_weights(p // 2))
    s = s.add(lean=half * F.lit(2.0) - fir(s, "real", linear_weights(p)))
    return s.add(hma=fir(s, "lean", linear_weights(root)))


@indicator("msw", "Mesa Sine Wave", "indicator", "W", "real", "msw_sine msw_lead", PERIOD, _after_frame)
def msw(s: Series, period) -> Series:
    p = int(period)
    pi = 3.1415926  # fixed value: this precision is part of the definition
    s = s.span(p - 1)
    turn = [2 * pi * j / p for j in reversed(range(p))]
    s = s.add(re=fir(s, "real", [math.cos(t) for t in turn]), im=fir(s, "real", [math.sin(t) for t in turn]))
    sign = F.when(c.im < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    angle = F.when(F.abs(c.re) > 0.001, F.atan(ratio(c.im, c.re))).otherwise(F.lit(pi) * sign)
    angle = angle + F.when(c.re < 0, F.lit(pi)).otherwise(F.lit(0.0)) + F.lit(pi / 2)
    s = s.add(phase=angle)
    wrapped = F.when(c.phase < 0, c.phase + F.lit(2 * pi)).otherwise(c.phase)
    s = s.add(phase=F.when(wrapped > 2 * pi, wrapped - F.lit(2 * pi)).otherwise(wrapped))
    return s.add(msw_sine=F.sin("phase"), msw_lead=F.sin(c.phase + F.lit(pi / 4)))


# -- spread --------------------------------------------------------------
@indicator("var", "Variance Over Period", "math", "W", "real", "var", PERIOD, _last_of_frame)
def var(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1)
    return s.add(var=F.var_pop("real").over(s.trail(p)))


@indicator("stddev", "Standard Deviation Over Period", "math", "W", "real", "stddev", PERIOD, _last_of_frame)
def stddev(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1)
    return s.add(stddev=F.stddev_pop("real").over(s.trail(p)))


@indicator("stderr", "Standard Error Over Period", "math", "W", "real", "stderr", PERIOD, _last_of_frame)
def stderr(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1)
    return s.add(stderr=F.stddev_pop("real").over(s.trail(p)) / F.lit(math.sqrt(p)))


@indicator("bbands", "Bollinger Bands", "overlay", "W", "real", "bbands_lower bbands_middle bbands_upper",
           "period stddev", lambda p, k: int(p) - 1, lambda p, k: p >= 1)
def bbands(s: Series, period, k) -> Series:
    p = int(period)
    s = s.span(p - 1)
    s = s.add(mean=F.avg("real").over(s.trail(p)), dev=F.stddev_pop("real").over(s.trail(p)) * F.lit(float(k)))
    return s.add(bbands_lower=c.mean - c.dev, bbands_middle=c.mean, bbands_upper=c.mean + c.dev)


@indicator("volatility", "Annualized Historical Volatility", "indicator", "W", "real", "volatility", PERIOD,
           _after_frame)
def volatility(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p)
    s = s.add(gain=ratio(c.real, s.lag("real")) - F.lit(1.0))
    # 252 trading days a year
    return s.add(volatility=F.stddev_pop("gain").over(s.trail(p)) * F.lit(math.sqrt(252)))


def mean_deviation(s: Series, column: str, p: int) -> Column:
    """Mean distance of the frame's values from the frame's mean."""
    values = F.collect_list(column).over(s.trail(p))
    mean = F.avg(column).over(s.trail(p))
    return F.aggregate(F.transform(values, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v) / F.lit(p)


@indicator("md", "Mean Deviation Over Period", "math", "W", "real", "md", PERIOD, _last_of_frame)
def md(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1)
    return s.add(md=mean_deviation(s, "real", p))


@indicator("cci", "Commodity Channel Index", "indicator", "W", "high low close", "cci", PERIOD,
           lambda p: 2 * (int(p) - 1))
def cci(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1).add(typical=(c.high + c.low + c.close) / F.lit(3.0))
    s = s.add(mean=F.avg("typical").over(s.trail(p)), dev=mean_deviation(s, "typical", p))
    return s.add(cci=ratio(c.typical - c.mean, c.dev * F.lit(0.015)))


# -- extremes ------------------------------------------------------------
def _extreme_rows(s: Series, p: int) -> Series:
    """Row numbers of the newest highest high and newest lowest low of the last p + 1 bars."""
    frame = s.trail(p + 1)
    top = F.max_by("rn", F.struct("high", "rn")).over(frame)
    low = F.min_by("rn", F.struct(c.low, (-c.rn).alias("back"))).over(frame)
    return s.add(top_rn=top, low_rn=low)


@indicator("aroon", "Aroon", "indicator", "W", "high low", "aroon_down aroon_up", PERIOD, _after_frame)
def aroon(s: Series, period) -> Series:
    p = int(period)
    s = _extreme_rows(s.span(p), p)
    unit = F.lit(100.0 / p)
    return s.add(
        aroon_down=(F.lit(p) - (c.rn - c.low_rn)).cast("double") * unit,
        aroon_up=(F.lit(p) - (c.rn - c.top_rn)).cast("double") * unit,
    )


@indicator("aroonosc", "Aroon Oscillator", "indicator", "W", "high low", "aroonosc", PERIOD, _after_frame)
def aroonosc(s: Series, period) -> Series:
    p = int(period)
    s = _extreme_rows(s.span(p), p)
    return s.add(aroonosc=(c.top_rn - c.low_rn).cast("double") * F.lit(100.0 / p))


@indicator("willr", "Williams %R", "indicator", "W", "high low close", "willr", PERIOD, _last_of_frame)
def willr(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1)
    s = s.add(top=F.max("high").over(s.trail(p)), bottom=F.min("low").over(s.trail(p)))
    return s.add(willr=F.coalesce(ratio(F.lit(-100.0) * (c.top - c.close), c.top - c.bottom), F.lit(0.0)))


@indicator("stoch", "Stochastic Oscillator", "indicator", "W", "high low close", "stoch_k stoch_d",
           "k_period k_slowing_period d_period", lambda k, n, d: int(k) + int(n) + int(d) - 3)
def stoch(s: Series, k_period, k_slow, d_period) -> Series:
    k, n, d = int(k_period), int(k_slow), int(d_period)
    s = s.span(k + n + d - 3)
    s = s.add(top=F.max("high").over(s.trail(k)), bottom=F.min("low").over(s.trail(k)))
    s = s.add(fast=F.coalesce(F.lit(100.0) * ratio(c.close - c.bottom, c.top - c.bottom), F.lit(0.0)))
    s = s.add(stoch_k=F.avg("fast").over(s.trail(n)))
    return s.add(stoch_d=F.avg("stoch_k").over(s.trail(d)))


@indicator("vhf", "Vertical Horizontal Filter", "indicator", "W", "real", "vhf", PERIOD, _after_frame)
def vhf(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p)
    s = s.add(move=F.abs(c.real - s.lag("real")))
    width = F.max("real").over(s.trail(p)) - F.min("real").over(s.trail(p))
    return s.add(vhf=ratio(width, F.sum("move").over(s.trail(p))))


# -- flows ---------------------------------------------------------------
def moves(s: Series) -> Series:
    """Size of the upward and downward move into each bar; needs span(1)."""
    step = c.real - s.lag("real")
    zero = F.lit(0.0)
    return s.add(up=F.when(step > 0, step).otherwise(zero), down=F.when(step < 0, -step).otherwise(zero))


@indicator("cmo", "Chande Momentum Oscillator", "indicator", "W", "real", "cmo", PERIOD, _after_frame)
def cmo(s: Series, period) -> Series:
    p = int(period)
    s = moves(s.span(p))
    up, down = F.sum("up").over(s.trail(p)), F.sum("down").over(s.trail(p))
    return s.add(cmo=ratio(F.lit(100.0) * (up - down), up + down))


@indicator("mfi", "Money Flow Index", "indicator", "W", "high low close volume", "mfi", PERIOD, _after_frame)
def mfi(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p).add(typical=(c.high + c.low + c.close) / F.lit(3.0))
    step, flow = c.typical - s.lag("typical"), c.typical * c.volume
    s = s.add(
        up=F.when(step > 0, flow).otherwise(F.lit(0.0)), down=F.when(step < 0, flow).otherwise(F.lit(0.0))
    )
    up, down = F.sum("up").over(s.trail(p)), F.sum("down").over(s.trail(p))
    return s.add(mfi=ratio(F.lit(100.0) * up, up + down))


@indicator("ultosc", "Ultimate Oscillator", "indicator", "W", "high low close", "ultosc",
           "short_period medium_period long_period", lambda a, b, n: int(n), _ordered)
def ultosc(s: Series, short, medium, long) -> Series:
    s = s.span(int(long))
    floor = F.least(c.low, s.lag("close"))
    s = s.add(
        pressure=F.when(c.rn > 1, c.close - floor),
        width=F.when(c.rn > 1, F.greatest(c.high, s.lag("close")) - floor),
    )

    def share(p):
        frame = s.trail(int(p))
        return ratio(F.sum("pressure").over(frame), F.sum("width").over(frame))

    mix = share(short) * F.lit(4.0) + share(medium) * F.lit(2.0) + share(long)
    return s.add(ultosc=mix * F.lit(100.0 / 7.0))


# -- family C: running totals --------------------------------------------
def money_flow():
    """Volume weighted by where the close lies in the bar; 0 for a bar without range."""
    place = ratio((c.close - c.low) - (c.high - c.close), c.high - c.low)
    return F.coalesce(place * c.volume, F.lit(0.0))


@indicator("ad", "Accumulation/Distribution Line", "indicator", "C", "high low close volume", "ad")
def ad(s: Series) -> Series:
    return s.running_sum(ad=money_flow())


@indicator("obv", "On Balance Volume", "indicator", "C", "close volume", "obv")
def obv(s: Series) -> Series:
    s = s.span(1)
    turn = F.coalesce(F.signum(c.close - s.lag("close")), F.lit(0.0))
    return s.add(signed=turn * c.volume).running_sum(obv=c.signed)


@indicator("wad", "Williams Accumulation/Distribution", "indicator", "C", "high low close", "wad", start=1)
def wad(s: Series) -> Series:
    s = s.span(1).add(last=F.lag("close").over(s.w))
    gain = F.when(c.close > c.last, c.close - F.least(c.last, c.low))
    gain = gain.when(c.close < c.last, c.close - F.greatest(c.last, c.high)).otherwise(F.lit(0.0))
    return s.add(gain=gain).running_sum(wad=c.gain)
