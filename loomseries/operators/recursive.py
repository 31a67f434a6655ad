"""Family R: each output depends on the one before it.

Every indicator here is stated as columns of a step v = a * v + b (or with a
floor) and handed to ``scan``; only ``fisher`` and ``psar`` have steps that do
not compose and use ``state_scan``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.series import Series, c, ratio
from .lags import true_range
from .registry import indicator
from .scan import Step, floats, scan, state_scan, step_after, step_seed
from .windows import money_flow, moves

PERIOD = "period"
FAST_SLOW = "short_period long_period"


def _ema_step(x: Column, period: float | None, seed_at: int = 1, weight: float | None = None, seed=None):
    """Exponential mean with weight 2 / (period + 1), seeded with ``x`` on row ``seed_at``."""
    k = weight if weight is not None else 2.0 / (int(period) + 1)
    return step_seed(F.lit(seed_at), x if seed is None else seed, 1.0 - k, x * F.lit(k))


def _fast_slow(short, long):
    return short >= 1 and long >= 2 and long >= short


@indicator("ema", "Exponential Moving Average", "overlay", "R", "real", "ema", PERIOD)
def ema(s: Series, period) -> Series:
    return scan(s, ema=_ema_step(c.real, period))


@indicator("apo", "Absolute Price Oscillator", "indicator", "R", "real", "apo", FAST_SLOW, 1, _fast_slow)
def apo(s: Series, short, long) -> Series:
    s = scan(s, fast=_ema_step(c.real, short), slow=_ema_step(c.real, long))
    return s.add(apo=c.fast - c.slow)


@indicator("ppo", "Percentage Price Oscillator", "indicator", "R", "real", "ppo", FAST_SLOW, 1, _fast_slow)
def ppo(s: Series, short, long) -> Series:
    s = scan(s, fast=_ema_step(c.real, short), slow=_ema_step(c.real, long))
    return s.add(ppo=ratio(F.lit(100.0) * (c.fast - c.slow), c.slow))


@indicator("adosc", "Accumulation/Distribution Oscillator", "indicator", "R", "high low close volume", "adosc",
           FAST_SLOW, lambda a, b: int(b) - 1, lambda a, b: a >= 1 and b >= a)
def adosc(s: Series, short, long) -> Series:
    s = s.running_sum(line=money_flow())
    s = scan(s, fast=_ema_step(c.line, short), slow=_ema_step(c.line, long))
    return s.add(adosc=c.fast - c.slow)


@indicator("macd", "Moving Average Convergence/Divergence", "indicator", "R", "real",
           "macd macd_signal macd_histogram", "short_period long_period signal_period",
           lambda a, b, n: int(b) - 1, lambda a, b, n: _fast_slow(a, b) and n >= 1)
def macd(s: Series, short, long, signal) -> Series:
    # The pair 12 / 26 uses the weights 0.15 and 0.075.
    classic = int(short) == 12 and int(long) == 26
    fast = _ema_step(c.real, short, weight=0.15 if classic else None)
    slow = _ema_step(c.real, long, weight=0.075 if classic else None)
    # The signal is a mean of fast - slow, hence the difference of the means of both.
    k = 2.0 / (int(signal) + 1)
    s = scan(s, fast=fast, slow=slow, fast_mean=step_after(int(long), "fast", k), slow_mean=step_after(int(long), "slow", k))
    s = s.add(macd=c.fast - c.slow, macd_signal=c.fast_mean - c.slow_mean)
    return s.add(macd_histogram=c.macd - c.macd_signal)


@indicator("dema", "Double Exponential Moving Average", "overlay", "R", "real", "dema", PERIOD,
           lambda p: 2 * (int(p) - 1))
def dema(s: Series, period) -> Series:
    p = int(period)
    s = scan(s, e1=_ema_step(c.real, p), e2=step_after(p, "e1", 2.0 / (p + 1)))
    return s.add(dema=c.e1 * F.lit(2.0) - c.e2)


def _triple(s: Series, period) -> Series:
    """Three exponential means, each seeded from the one before once that has seen ``period`` rows."""
    p = int(period)
    k = 2.0 / (p + 1)
    return scan(s, e1=_ema_step(c.real, p), e2=step_after(p, "e1", k), e3=step_after(2 * p - 1, "e2", k))


@indicator("tema", "Triple Exponential Moving Average", "overlay", "R", "real", "tema", PERIOD,
           lambda p: 3 * (int(p) - 1))
def tema(s: Series, period) -> Series:
    s = _triple(s, period)
    return s.add(tema=(c.e1 - c.e2) * F.lit(3.0) + c.e3)


@indicator("trix", "Trix", "indicator", "R", "real", "trix", PERIOD, lambda p: 3 * (int(p) - 1) + 1)
def trix(s: Series, period) -> Series:
    s = _triple(s, period).span(1)
    return s.add(trix=ratio(c.e3 - s.lag("e3"), c.e3) * F.lit(100.0))


@indicator("zlema", "Zero-Lag Exponential Moving Average", "overlay", "R", "real", "zlema", PERIOD,
           lambda p: (int(p) - 1) // 2 - 1, lambda p: p >= 3)
def zlema(s: Series, period) -> Series:
    back = (int(period) - 1) // 2
    s = s.span(back)
    s = s.add(lean=F.coalesce(c.real * F.lit(2.0) - s.lag("real", back), F.lit(0.0)))
    return scan(s, zlema=_ema_step(c.lean, period, back, seed=c.real))


def _wilder_step(x: Column, first_mean: Column, period: int, seed_at: int):
    """Seeded with a mean of ``period`` rows, then moved by 1/period of the distance."""
    return step_seed(F.lit(seed_at), first_mean, (period - 1) / period, x * F.lit(1.0 / period))


@indicator("wilders", "Wilders Smoothing", "overlay", "R", "real", "wilders", PERIOD, lambda p: int(p) - 1)
def wilders(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1)
    s = s.add(mean=F.avg("real").over(s.trail(p)))
    return scan(s, wilders=_wilder_step(c.real, c.mean, p, p))


def _atr(s: Series, p: int) -> Series:
    s = s.span(p)
    s = s.add(range=true_range(s))
    s = s.add(mean=F.avg("range").over(s.trail(p)))
    return scan(s, atr=_wilder_step(c.range, c.mean, p, p))


@indicator("atr", "Average True Range", "indicator", "R", "high low close", "atr", PERIOD, lambda p: int(p) - 1)
def atr(s: Series, period) -> Series:
    return _atr(s, int(period))


@indicator("natr", "Normalized Average True Range", "indicator", "R", "high low close", "natr", PERIOD,
           lambda p: int(p) - 1)
def natr(s: Series, period) -> Series:
    return _atr(s, int(period)).add(natr=ratio(F.lit(100.0) * c.atr, c.close))


def _rsi(s: Series, p: int) -> Series:
    s = moves(s.span(p))
    s = s.add(up0=F.avg("up").over(s.trail(p)), down0=F.avg("down").over(s.trail(p)))
    s = scan(s, gain=_wilder_step(c.up, c.up0, p, p + 1), loss=_wilder_step(c.down, c.down0, p, p + 1))
    return s.add(rsi=F.lit(100.0) * ratio(c.gain, c.gain + c.loss))


@indicator("rsi", "Relative Strength Index", "indicator", "R", "real", "rsi", PERIOD, lambda p: int(p))
def rsi(s: Series, period) -> Series:
    return _rsi(s, int(period))


@indicator("stochrsi", "Stochastic RSI", "indicator", "R", "real", "stochrsi", PERIOD,
           lambda p: 2 * int(p) - 1, lambda p: p >= 2)
def stochrsi(s: Series, period) -> Series:
    p = int(period)
    s = _rsi(s, p).span(p - 1)
    s = s.add(top=F.max("rsi").over(s.trail(p)), bottom=F.min("rsi").over(s.trail(p)))
    return s.add(stochrsi=F.coalesce(ratio(c.rsi - c.bottom, c.top - c.bottom), F.lit(0.0)))


def _directional(s: Series) -> Series:
    """Directional movement into each bar: the larger of the two one-sided moves, else 0; needs span(1)."""
    s = s.add(rise=c.high - s.lag("high"), fall=s.lag("low") - c.low)
    zero = F.lit(0.0)
    return s.add(
        plus=F.when((c.rise > 0) & ~(c.fall > c.rise), c.rise).otherwise(zero),
        minus=F.when((c.fall > 0) & ~(c.rise > c.fall), c.fall).otherwise(zero),
    )


def _decayed_sums(s: Series, p: int, **columns: Column) -> Series:
    """Sum of the first ``p`` rows, then (p - 1)/p of the sum before plus the row."""
    s = s.add(**{f"_f_{n}": F.sum(x).over(s.trail(p)) for n, x in columns.items()})
    steps = {n: step_seed(F.lit(p), F.col(f"_f_{n}"), (p - 1) / p, x) for n, x in columns.items()}
    return scan(s, **steps)


@indicator("dm", "Directional Movement", "indicator", "R", "high low", "plus_dm minus_dm", PERIOD,
           lambda p: int(p) - 1)
def dm(s: Series, period) -> Series:
    p = int(period)
    return _decayed_sums(_directional(s.span(p)), p, plus_dm=c.plus, minus_dm=c.minus)


@indicator("di", "Directional Indicator", "indicator", "R", "high low close", "plus_di minus_di", PERIOD,
           lambda p: int(p) - 1)
def di(s: Series, period) -> Series:
    p = int(period)
    s = _directional(s.span(p))
    # The first bar has no bar before it and counts for none of the three sums.
    s = s.add(range=F.when(c.rn == 1, F.lit(0.0)).otherwise(true_range(s)))
    s = _decayed_sums(s, p, plus_dm=c.plus, minus_dm=c.minus, total=c.range)
    return s.add(
        plus_di=ratio(F.lit(100.0) * c.plus_dm, c.total), minus_di=ratio(F.lit(100.0) * c.minus_dm, c.total)
    )


def _dx(s: Series, p: int) -> Series:
    s = dm(s, p)
    return s.add(dx=ratio(F.abs(c.plus_dm - c.minus_dm), c.plus_dm + c.minus_dm) * F.lit(100.0))


@indicator("dx", "Directional Movement Index", "indicator", "R", "high low", "dx", PERIOD, lambda p: int(p) - 1)
def dx(s: Series, period) -> Series:
    return _dx(s, int(period))


def _adx(s: Series, p: int) -> Series:
    s = _dx(s, p).span(p - 1)
    s = s.add(mean=F.when(F.count("dx").over(s.trail(p)) == p, F.avg("dx").over(s.trail(p))))
    return scan(s, adx=_wilder_step(c.dx, c.mean, p, 2 * p - 1))


@indicator("adx", "Average Directional Movement Index", "indicator", "R", "high low", "adx", PERIOD,
           lambda p: 2 * (int(p) - 1), lambda p: p >= 2)
def adx(s: Series, period) -> Series:
    return _adx(s, int(period))


@indicator("adxr", "Average Directional Movement Rating", "indicator", "R", "high low", "adxr", PERIOD,
           lambda p: 3 * (int(p) - 1), lambda p: p >= 2)
def adxr(s: Series, period) -> Series:
    p = int(period)
    s = _adx(s, p).span(p - 1)
    return s.add(adxr=(c.adx + s.lag("adx", p - 1)) * F.lit(0.5))


@indicator("cvi", "Chaikins Volatility", "indicator", "R", "high low", "cvi", PERIOD, lambda p: 2 * int(p) - 1)
def cvi(s: Series, period) -> Series:
    p = int(period)
    s = scan(s, e1=_ema_step(c.high - c.low, p)).span(p)
    return s.add(cvi=ratio(F.lit(100.0) * (c.e1 - s.lag("e1", p)), s.lag("e1", p)))


@indicator("mass", "Mass Index", "indicator", "R", "high low", "mass", PERIOD, lambda p: int(p) + 15)
def mass(s: Series, period) -> Series:
    p = int(period)
    # Fixed value: both means run over 9 bars.
    s = scan(s, e1=_ema_step(c.high - c.low, 9), e2=step_after(9, "e1", 0.2)).span(p - 1)
    s = s.add(part=ratio(c.e1, c.e2))
    full = F.count("part").over(s.trail(p)) == p
    return s.add(mass=F.when(full, F.sum("part").over(s.trail(p))))


@indicator("kama", "Kaufman Adaptive Moving Average", "overlay", "R", "real", "kama", PERIOD, lambda p: int(p) - 1)
def kama(s: Series, period) -> Series:
    p = int(period)
    fast, slow = 2.0 / 3.0, 2.0 / 31.0  # fixed values: exponential weights of 2 and 30 rows
    s = s.span(p)
    s = s.add(move=F.abs(c.real - s.lag("real")), whole=F.abs(c.real - s.lag("real", p)))
    share = F.coalesce(ratio(c.whole, F.sum("move").over(s.trail(p))), F.lit(1.0))
    s = s.add(pull=F.pow(share * F.lit(fast - slow) + F.lit(slow), F.lit(2.0)))
    return scan(s, kama=step_seed(F.lit(p), c.real, F.lit(1.0) - c.pull, c.pull * c.real))


@indicator("vidya", "Variable Index Dynamic Average", "overlay", "R", "real", "vidya",
           "short_period long_period alpha", lambda a, b, k: int(b) - 2,
           lambda a, b, k: a >= 1 and b >= a and b >= 2 and 0.0 <= k <= 1.0)
def vidya(s: Series, short, long, alpha) -> Series:
    n, m = int(short), int(long)
    s = s.span(m - 1)
    spread = ratio(F.stddev_pop("real").over(s.trail(n)), F.stddev_pop("real").over(s.trail(m)))
    s = s.add(pull=F.coalesce(spread, F.lit(0.0)) * F.lit(float(alpha)))
    return scan(s, vidya=step_seed(F.lit(m - 1), c.real, F.lit(1.0) - c.pull, c.pull * c.real))


def _volume_index(s: Series, counts, name: str) -> Series:
    """Starts at 1000 and follows the close on the bars where ``counts(volume, last volume)``."""
    s = s.span(1)
    factor = F.when(counts(c.volume, s.lag("volume")), ratio(c.close, s.lag("close"))).otherwise(F.lit(1.0))
    return scan(s.add(factor=factor), **{name: step_seed(F.lit(1), F.lit(1000.0), c.factor, F.lit(0.0))})


@indicator("nvi", "Negative Volume Index", "indicator", "R", "close volume", "nvi")
def nvi(s: Series) -> Series:
    return _volume_index(s, lambda v, last: v < last, "nvi")


@indicator("pvi", "Positive Volume Index", "indicator", "R", "close volume", "pvi")
def pvi(s: Series) -> Series:
    return _volume_index(s, lambda v, last: v > last, "pvi")


@indicator("decay", "Linear Decay", "math", "R", "real", "decay", PERIOD)
def decay(s: Series, period) -> Series:
    a = F.when(c.rn == 1, F.lit(0.0)).otherwise(F.lit(1.0))
    b = F.when(c.rn == 1, c.real).otherwise(F.lit(-1.0 / int(period)))
    return scan(s, decay=Step(a, b, c.real))


@indicator("edecay", "Exponential Decay", "math", "R", "real", "edecay", PERIOD)
def edecay(s: Series, period) -> Series:
    a = F.when(c.rn == 1, F.lit(0.0)).otherwise(F.lit(1.0 - 1.0 / int(period)))
    b = F.when(c.rn == 1, c.real).otherwise(F.lit(0.0))
    return scan(s, edecay=Step(a, b, c.real))


@indicator("kvo", "Klinger Volume Oscillator", "indicator", "R", "high low close volume", "kvo", FAST_SLOW, 1,
           lambda a, b: a >= 1 and b >= a)
def kvo(s: Series, short, long) -> Series:
    s = s.span(1)
    s = s.add(price=c.high + c.low + c.close, width=c.high - c.low)
    s = s.add(step=F.signum(c.price - s.lag("price")), last_width=s.lag("width"))
    # The trend is the last direction that was not flat, NULL until there was one.
    s = s.running_last(trend=F.when((c.step != 0) & (c.rn > 1), c.step)).span(1)
    s = s.add(turned=~c.trend.eqNullSafe(s.lag("trend")))
    first = F.col("turned") | (c.rn == 1)
    cum_a = F.when(first, F.lit(0.0)).otherwise(F.lit(1.0))
    cum_b = F.when(c.rn == 1, F.lit(0.0)).when(c.turned, c.last_width + c.width).otherwise(c.width)
    s = scan(s, cum=Step(cum_a, cum_b))
    sign = F.when(c.trend < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    s = s.add(force=c.volume * F.abs(ratio(c.width, c.cum) * F.lit(2.0) - F.lit(1.0)) * F.lit(100.0) * sign)
    s = scan(s, fast=_ema_step(c.force, short, 2), slow=_ema_step(c.force, long, 2))
    return s.add(kvo=c.fast - c.slow)


def _fisher_step(rows, state):
    pull = 0.0 if np.isnan(state[0]) else state[0]
    fish = 0.0 if np.isnan(state[1]) else state[1]
    n = rows.num_rows
    now, before = np.full(n, np.nan), np.full(n, np.nan)
    for i, place in enumerate(floats(rows, "place").tolist()):
        if place != place:  # still in the warm-up
            continue
        pull = 0.66 * place + 0.67 * pull
        pull = 0.999 if pull > 0.99 else -0.999 if pull < -0.99 else pull
        before[i] = fish
        fish = float(np.arctanh(pull)) + 0.5 * fish
        now[i] = fish
    return {"fisher": now, "fisher_signal": before}, np.array([pull, fish])


@indicator("fisher", "Fisher Transform", "indicator", "R", "high low", "fisher fisher_signal", PERIOD,
           lambda p: int(p) - 1)
def fisher(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p - 1).add(mid=(c.high + c.low) * F.lit(0.5))
    s = s.add(top=F.max("mid").over(s.trail(p)), bottom=F.min("mid").over(s.trail(p)))
    width = F.when(c.top == c.bottom, F.lit(0.001)).otherwise(c.top - c.bottom)
    s = s.add(place=F.when(c.rn >= p, (c.mid - c.bottom) / width - F.lit(0.5)))
    return state_scan(s, _fisher_step, 2, ["fisher", "fisher_signal"])


def _psar_step(unit: float, limit: float):
    """State: direction (1 up, -1 down), stop, extreme, acceleration.

    Prices are multiplied by the direction, so that one set of rules serves both.
    """

    def step(rows, state):
        way, stop, edge, pace = state
        out = np.full(rows.num_rows, np.nan)
        columns = (floats(rows, n).tolist() for n in ("high", "low", "high1", "low1", "high2", "low2"))
        for i, (hi, lo, hi1, lo1, hi2, lo2) in enumerate(zip(*columns)):
            if hi1 != hi1:  # first bar of the key
                continue
            if way != way:
                way = 1.0 if hi1 + lo1 <= hi + lo else -1.0
                edge, stop = (hi1, lo1) if way > 0 else (lo1, hi1)
                pace = unit
            stop = (edge - stop) * pace + stop
            ahead, behind = (hi, lo) if way > 0 else (lo, hi)
            behind1, behind2 = (lo1, lo2) if way > 0 else (hi1, hi2)
            if behind2 == behind2:
                stop = way * min(way * stop, way * behind2)
            stop = way * min(way * stop, way * behind1)
            if way * ahead > way * edge:
                edge, pace = ahead, min(pace + unit, limit)
            if way * behind < way * stop:
                stop, pace, way, edge = edge, unit, -way, behind
            out[i] = stop
        return {"psar": out}, np.array([way, stop, edge, pace])

    return step


@indicator("psar", "Parabolic SAR", "overlay", "R", "high low", "psar",
           "acceleration_factor_step acceleration_factor_maximum", 1, lambda a, b: a > 0 and b > a)
def psar(s: Series, unit, limit) -> Series:
    s = s.span(2)
    s = s.add(high1=s.lag("high"), low1=s.lag("low"), high2=s.lag("high", 2), low2=s.lag("low", 2))
    return state_scan(s, _psar_step(float(unit), float(limit)), 4, ["psar"])
