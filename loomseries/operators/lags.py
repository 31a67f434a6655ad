"""Family L: fixed distances back. One shuffle, halo of that distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.series import Series, c, ratio
from .registry import indicator



def _flag(condition):
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def _crossings(s: Series):
    s = s.span(1)
    above = (c.real > c.real2) & (s.lag("real") <= s.lag("real2"))
    below = (c.real < c.real2) & (s.lag("real") >= s.lag("real2"))
    return s, above, below


@indicator("crossany", "Crossany", "math", "L", "real real2", "crossany", start=1)
def crossany(s: Series) -> Series:
    s, above, below = _crossings(s)
    return s.add(crossany=_flag(above | below))


@indicator("crossover", "Crossover", "math", "L", "real real2", "crossover", start=1)
def crossover(s: Series) -> Series:
    s, above, _ = _crossings(s)
    return s.add(crossover=_flag(above))


@indicator("emv", "Ease of Movement", "indicator", "L", "high low volume", "emv", start=1)
def emv(s: Series) -> Series:
    s = s.span(1).add(mid=(c.high + c.low) * F.lit(0.5))
    box = c.volume / F.lit(10000.0) / F.when(c.high != c.low, c.high - c.low)
    move = F.col("mid") - s.lag("mid")
    # A bar without range makes the box infinite, hence the move over it 0.
    return s.add(emv=F.when((c.high == c.low) & (c.volume != 0), F.lit(0.0)).otherwise(ratio(move, box)))


def _not_negative(period):
    return period >= 0


@indicator("lag", "Lag", "math", "L", "real", "lag", "period", lambda p: int(p), _not_negative)
def lag(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p)
    return s.add(lag=s.lag("real", p) if p else c.real)


@indicator("mom", "Momentum", "indicator", "L", "real", "mom", "period", lambda p: int(p))
def mom(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p)
    return s.add(mom=c.real - s.lag("real", p))


@indicator("roc", "Rate of Change", "indicator", "L", "real", "roc", "period", lambda p: int(p))
def roc(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p)
    return s.add(roc=ratio(c.real - s.lag("real", p), s.lag("real", p)))


@indicator("rocr", "Rate of Change Ratio", "indicator", "L", "real", "rocr", "period", lambda p: int(p))
def rocr(s: Series, period) -> Series:
    p = int(period)
    s = s.span(p)
    return s.add(rocr=ratio(c.real, s.lag("real", p)))


def true_range(s: Series):
    """Largest of the bar's range and its distances from the last close; needs span(1)."""
    last = s.lag("close")
    return F.greatest(c.high - c.low, F.abs(c.high - last), F.abs(c.low - last))


@indicator("tr", "True Range", "indicator", "L", "high low close", "tr")
def tr(s: Series) -> Series:
    s = s.span(1)
    return s.add(tr=true_range(s))
