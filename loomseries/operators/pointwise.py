"""Family P: each output row depends on its own input row only. No shuffle."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..plans.series import c, ratio
from .registry import indicator


EXACT = float(2**53)  # from here on every double is a whole number


def whole(x, rounding):
    """``rounding(x)`` as a double; Spark's own result type is a bigint, which large values overflow."""
    return F.when(F.abs(x) < F.lit(EXACT), rounding(x).cast("double")).otherwise(x)


def _simple(name, full_name, column, inputs="real", output=None):
    indicator(name, full_name, "simple", "P", inputs, output or name)(lambda: [column()])


_simple("abs", "Vector Absolute Value", lambda: F.abs(c.real))
_simple("acos", "Vector Arccosine", lambda: F.acos(c.real))
_simple("add", "Vector Addition", lambda: c.real + c.real2, "real real2")
_simple("asin", "Vector Arcsine", lambda: F.asin(c.real))
_simple("atan", "Vector Arctangent", lambda: F.atan(c.real))
_simple("ceil", "Vector Ceiling", lambda: whole(c.real, F.ceil))
_simple("cos", "Vector Cosine", lambda: F.cos(c.real))
_simple("cosh", "Vector Hyperbolic Cosine", lambda: F.cosh(c.real))
_simple("div", "Vector Division", lambda: ratio(c.real, c.real2), "real real2")
_simple("exp", "Vector Exponential", lambda: F.exp(c.real))
_simple("floor", "Vector Floor", lambda: whole(c.real, F.floor))
_simple("ln", "Vector Natural Log", lambda: F.ln(c.real))
_simple("log10", "Vector Base-10 Log", lambda: F.log10(c.real))
_simple("mul", "Vector Multiplication", lambda: c.real * c.real2, "real real2")
# Ties go up, not away from zero, so this is not F.round.
_simple("round", "Vector Round", lambda: whole(c.real + F.lit(0.5), F.floor))
_simple("sin", "Vector Sine", lambda: F.sin(c.real))
_simple("sinh", "Vector Hyperbolic Sine", lambda: F.sinh(c.real))
_simple("sqrt", "Vector Square Root", lambda: F.sqrt(c.real))
_simple("sub", "Vector Subtraction", lambda: c.real - c.real2, "real real2")
_simple("tan", "Vector Tangent", lambda: F.tan(c.real))
_simple("tanh", "Vector Hyperbolic Tangent", lambda: F.tanh(c.real))
_simple("todeg", "Vector Degree Conversion", lambda: c.real * F.lit(180.0 / math.pi), output="degrees")
_simple("torad", "Vector Radian Conversion", lambda: c.real * F.lit(math.pi / 180.0), output="radians")
_simple("trunc", "Vector Truncate", lambda: whole(c.real, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))))


@indicator("avgprice", "Average Price", "overlay", "P", "open high low close", "avgprice")
def avgprice():
    return [(c.open + c.high + c.low + c.close) * F.lit(0.25)]


@indicator("bop", "Balance of Power", "indicator", "P", "open high low close", "bop")
def bop():
    return [F.when(c.high - c.low <= 0, F.lit(0.0)).otherwise(ratio(c.close - c.open, c.high - c.low))]


@indicator("marketfi", "Market Facilitation Index", "indicator", "P", "high low volume", "marketfi")
def marketfi():
    return [ratio(c.high - c.low, c.volume)]


@indicator("medprice", "Median Price", "overlay", "P", "high low", "medprice")
def medprice():
    return [(c.high + c.low) * F.lit(0.5)]


@indicator("typprice", "Typical Price", "overlay", "P", "high low close", "typprice")
def typprice():
    return [(c.high + c.low + c.close) / F.lit(3.0)]


@indicator("wcprice", "Weighted Close Price", "overlay", "P", "high low close", "wcprice")
def wcprice():
    return [(c.high + c.low + c.close + c.close) * F.lit(0.25)]
