"""One query and its comparison SQL per indicator.

Operators over one series run on the raw events of each type; operators over
price bars run on bars of those events.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indicators import REGISTRY, compute
from ..plans.series import CHUNK_ROWS
from .series_sql import CUM, chain, lag, rec, trail
from .tables import BAR_GRAIN, TICK_GRAIN, bars, rounded, ticks


@dataclass(frozen=True)
class Case:
    source: str  # hour or day bars, or tick
    options: tuple = ()
    stages: list = field(default_factory=list)
    outputs: dict = field(default_factory=dict)
    inputs: dict[str, Callable] = field(default_factory=dict)
    digits: int = 6
    finish: Callable | None = None  # last change to the Spark result, e.g. a logarithm


CASES: dict[str, Case] = {}


def ema_rec(seed_at: int = 1, **means: tuple[str, float | str]) -> tuple:
    """Exponential means ``name=(column, weight)``, each seeded on row ``seed_at``."""
    init, step = {}, {}
    for name, (x, k) in means.items():
        init[name] = f"CASE WHEN {seed_at} = 1 THEN s.{x} ELSE 0 END"
        move = f"(s.{x} - r.{name}) * ({k}) + r.{name}"
        step[name] = f"CASE WHEN s.rn < {seed_at} THEN 0 WHEN s.rn = {seed_at} THEN s.{x} ELSE {move} END"
    return rec(init, step)


def wilder_rec(p: int, seed_at: int, **means: tuple[str, str]) -> tuple:
    """Means ``name=(column, seed column)`` that move by 1/p of the distance."""
    init, step = {}, {}
    for name, (x, seed) in means.items():
        init[name] = f"CASE WHEN {seed_at} = 1 THEN s.{seed} ELSE 0 END"
        move = f"(s.{x} - r.{name}) * (1.0 / {p}) + r.{name}"
        step[name] = f"CASE WHEN s.rn < {seed_at} THEN 0 WHEN s.rn = {seed_at} THEN s.{seed} ELSE {move} END"
    return rec(init, step)


def decayed_rec(p: int, **sums: tuple[str, str]) -> tuple:
    """Sums ``name=(column, first sum)`` that keep (p - 1)/p of the sum before."""
    init, step = {}, {}
    for name, (x, seed) in sums.items():
        init[name] = f"CASE WHEN {p} = 1 THEN s.{seed} ELSE 0 END"
        move = f"r.{name} * (({p} - 1.0) / {p}) + s.{x}"
        step[name] = f"CASE WHEN s.rn < {p} THEN 0 WHEN s.rn = {p} THEN s.{seed} ELSE {move} END"
    return rec(init, step)


def weight(p: int) -> str:
    return f"2.0 / ({p} + 1)"


# -- P -------------------------------------------------------------------
def _unit():
    return F.col("real") / F.lit(500.0)


def _small():
    return F.col("real") / F.lit(100.0)


for name in ("abs", "atan", "cos", "floor", "ln", "log10", "sin", "sqrt", "ceil", "trunc"):
    CASES[name] = Case("tick", outputs={name: f"{name}(real)"})
for name in ("acos", "asin"):
    CASES[name] = Case("tick", outputs={name: f"{name}(real / 500.0)"}, inputs={"real": _unit})
for name in ("cosh", "exp", "sinh", "tan", "tanh"):
    CASES[name] = Case("tick", outputs={name: f"{name}(real / 100.0)"}, inputs={"real": _small})
CASES["round"] = Case("tick", outputs={"round": "floor(real + 0.5)"})
CASES["todeg"] = Case("tick", outputs={"degrees": "degrees(real)"})
CASES["torad"] = Case("tick", outputs={"radians": "radians(real)"})
for name, sign in (("add", "+"), ("sub", "-"), ("mul", "*")):
    CASES[name] = Case("tick", outputs={name: f"real {sign} real2"}, inputs={"real2": lambda: F.col("user_id")})
CASES["div"] = Case("tick", outputs={"div": "real / nullif(real2, 0)"}, inputs={"real2": lambda: F.col("user_id")}, digits=10)
CASES["avgprice"] = Case("hour", outputs={"avgprice": "(open + high + low + close) / 4"})
CASES["bop"] = Case("hour", outputs={"bop": "CASE WHEN high - low <= 0 THEN 0 ELSE (close - open) / (high - low) END"})
CASES["marketfi"] = Case("hour", outputs={"marketfi": "(high - low) / nullif(volume, 0)"})
CASES["medprice"] = Case("hour", outputs={"medprice": "(high + low) / 2"})
CASES["typprice"] = Case("hour", outputs={"typprice": "(high + low + close) / 3"})
CASES["wcprice"] = Case("hour", outputs={"wcprice": "(high + low + 2 * close) / 4"})

# -- L -------------------------------------------------------------------
_cross = {"a0": lag("open"), "b0": lag("close")}
_pair = {"real": lambda: F.col("open"), "real2": lambda: F.col("close")}
_over = "(open > close AND a0 <= b0)"
CASES["crossover"] = Case("hour", (), [_cross], {"crossover": f"CAST({_over} AS DOUBLE)"}, _pair)
CASES["crossany"] = Case(
    "hour", (), [_cross], {"crossany": f"CAST({_over} OR (open < close AND a0 >= b0) AS DOUBLE)"}, _pair)
CASES["emv"] = Case(
    "hour", (), [{"mid": "(high + low) / 2"}, {"mid1": lag("mid")}],
    {"emv": "CASE WHEN high = low THEN 0 ELSE (mid - mid1) / (volume / 10000.0 / (high - low)) END"}, digits=3)
CASES["lag"] = Case("tick", (3,), [{"x": lag("real", 3)}], {"lag": "x"})
CASES["mom"] = Case("tick", (3,), [{"x": lag("real", 3)}], {"mom": "real - x"})
CASES["roc"] = Case("tick", (3,), [{"x": lag("real", 3)}], {"roc": "(real - x) / nullif(x, 0)"})
CASES["rocr"] = Case("tick", (3,), [{"x": lag("real", 3)}], {"rocr": "real / nullif(x, 0)"})
_tr = {"c1": lag("close")}
_tr_x = "CASE WHEN rn = 1 THEN high - low ELSE greatest(high - low, abs(high - c1), abs(low - c1)) END"
CASES["tr"] = Case("hour", (), [_tr], {"tr": _tr_x})

# -- W -------------------------------------------------------------------
P = 5
CASES["sma"] = Case("tick", (P,), [], {"sma": f"avg(real) {trail(P)}"})
CASES["sum"] = Case("tick", (P,), [], {"sum": f"sum(real) {trail(P)}"})
CASES["max"] = Case("tick", (P,), [], {"max": f"max(real) {trail(P)}"})
CASES["min"] = Case("tick", (P,), [], {"min": f"min(real) {trail(P)}"})
CASES["var"] = Case("tick", (P,), [], {"var": f"var_pop(real) {trail(P)}"})
CASES["stddev"] = Case("tick", (P,), [], {"stddev": f"stddev_pop(real) {trail(P)}"})
CASES["stderr"] = Case("tick", (P,), [], {"stderr": f"stddev_pop(real) {trail(P)} / sqrt({P})"})
CASES["bbands"] = Case(
    "tick", (P, 2), [{"m": f"avg(real) {trail(P)}", "d": f"2 * stddev_pop(real) {trail(P)}"}],
    {"bbands_lower": "m - d", "bbands_middle": "m", "bbands_upper": "m + d"})
CASES["ao"] = Case(
    "hour", (), [{"m": "(high + low) / 2"}], {"ao": f"avg(m) {trail(5)} - avg(m) {trail(34)}"})
CASES["qstick"] = Case("hour", (P,), [], {"qstick": f"avg(close - open) {trail(P)}"})
CASES["dpo"] = Case("tick", (P,), [], {"dpo": f"{lag('real', 3)} - avg(real) {trail(P)}"})
CASES["vosc"] = Case(
    "hour", (2, 5), [{"a": f"avg(volume) {trail(2)}", "b": f"avg(volume) {trail(5)}"}],
    {"vosc": "100 * (a - b) / nullif(b, 0)"})
CASES["vwma"] = Case(
    "hour", (P,), [], {"vwma": f"sum(close * volume) {trail(P)} / nullif(sum(volume) {trail(P)}, 0)"})


def _dot(x: str, weights: list[str]) -> str:
    """Weighted sum of the trailing rows, the last weight on the current row."""
    n = len(weights)
    return " + ".join(f"({w}) * {lag(x, n - 1 - k)}" for k, w in enumerate(weights))


CASES["wma"] = Case("tick", (P,), [], {"wma": f"({_dot('real', ['1', '2', '3', '4', '5'])}) / 15"})
CASES["trima"] = Case("tick", (P,), [], {"trima": f"({_dot('real', ['1', '2', '3', '2', '1'])}) / 9"})
_line = {"b": f"regr_slope(real, rn) {trail(P)}", "m": f"avg(real) {trail(P)}"}
CASES["linreg"] = Case("tick", (P,), [_line], {"linreg": "m + 2 * b"})
CASES["linregintercept"] = Case("tick", (P,), [_line], {"linregintercept": "m - 2 * b"})
CASES["linregslope"] = Case("tick", (P,), [_line], {"linregslope": "b"})
CASES["tsf"] = Case("tick", (P,), [_line], {"tsf": "m + 3 * b"})
CASES["fosc"] = Case(
    "tick", (7,),
    [{"f": f"avg(real) {trail(7)} + 4 * regr_slope(real, rn) {trail(7)}"}, {"f1": lag("f")}],
    {"fosc": "100 * (real - f1) / nullif(real, 0)"}, digits=5)
_wma9 = "(" + _dot("real", [str(k) for k in range(1, 10)]) + ") / 45"
_wma4 = "(" + _dot("real", [str(k) for k in range(1, 5)]) + ") / 10"
CASES["hma"] = Case(
    "tick", (9,), [{"w9": _wma9, "w4": _wma4}, {"d": "2 * w4 - w9"}],
    {"hma": "(" + _dot("d", ["1", "2", "3"]) + ") / 6"})
_pi = "3.1415926"
_turns = [f"2 * {_pi} * {j} / {P}" for j in reversed(range(P))]
CASES["msw"] = Case(
    "tick", (P,),
    [{"re": _dot("real", [f"cos({t})" for t in _turns]), "im": _dot("real", [f"sin({t})" for t in _turns])},
     {"p0": f"CASE WHEN abs(re) > 0.001 THEN atan(im / re) ELSE {_pi} * CASE WHEN im < 0 THEN -1 ELSE 1 END END"},
     {"p1": f"p0 + CASE WHEN re < 0 THEN {_pi} ELSE 0 END + {_pi} / 2"},
     {"p2": f"CASE WHEN p1 < 0 THEN p1 + 2 * {_pi} ELSE p1 END"},
     {"p3": f"CASE WHEN p2 > 2 * {_pi} THEN p2 - 2 * {_pi} ELSE p2 END"}],
    {"msw_sine": "sin(p3)", "msw_lead": f"sin(p3 + {_pi} / 4)"})
CASES["volatility"] = Case(
    "tick", (P,), [{"g": f"real / nullif({lag('real')}, 0) - 1"}],
    {"volatility": f"stddev_pop(g) {trail(P)} * sqrt(252)"}, digits=4)
CASES["md"] = Case(
    "tick", (P,), [{"m": f"avg(real) {trail(P)}", "vals": f"array_agg(real) {trail(P)}"}],
    {"md": f"list_sum(list_transform(vals, lambda v: abs(v - m))) / {P}"})
CASES["cci"] = Case(
    "hour", (P,),
    [{"tp": "(high + low + close) / 3"}, {"m": f"avg(tp) {trail(P)}", "vals": f"array_agg(tp) {trail(P)}"},
     {"d": f"list_sum(list_transform(vals, lambda v: abs(v - m))) / {P}"}],
    {"cci": "(tp - m) / nullif(0.015 * d, 0)"})
_ext = {
    "tops": f"arg_max(rn, (high, rn)) {trail(P + 1)}",
    "bots": f"arg_min(rn, (low, -rn)) {trail(P + 1)}",
}
CASES["aroon"] = Case(
    "hour", (P,), [_ext],
    {"aroon_down": f"({P} - (rn - bots)) * 100.0 / {P}", "aroon_up": f"({P} - (rn - tops)) * 100.0 / {P}"})
CASES["aroonosc"] = Case("hour", (P,), [_ext], {"aroonosc": f"(tops - bots) * 100.0 / {P}"})
_hl = {"hh": f"max(high) {trail(P)}", "ll": f"min(low) {trail(P)}"}
CASES["willr"] = Case(
    "hour", (P,), [_hl], {"willr": "CASE WHEN hh = ll THEN 0 ELSE -100 * (hh - close) / (hh - ll) END"})
CASES["stoch"] = Case(
    "hour", (5, 3, 3),
    [_hl, {"f": "CASE WHEN hh = ll THEN 0 ELSE 100 * (close - ll) / (hh - ll) END"}, {"k": f"avg(f) {trail(3)}"}],
    {"stoch_k": "k", "stoch_d": f"avg(k) {trail(3)}"})
_step = {"x1": lag("real")}
CASES["vhf"] = Case(
    "tick", (P,), [_step, {"mv": "abs(real - x1)"}],
    {"vhf": f"(max(real) {trail(P)} - min(real) {trail(P)}) / nullif(sum(mv) {trail(P)}, 0)"})
_ups = [_step, {"up": "CASE WHEN real > x1 THEN real - x1 ELSE 0 END", "dn": "CASE WHEN real < x1 THEN x1 - real ELSE 0 END"}]
_su, _sd = f"sum(up) {trail(P)}", f"sum(dn) {trail(P)}"
CASES["cmo"] = Case("tick", (P,), _ups, {"cmo": f"100 * ({_su} - {_sd}) / nullif({_su} + {_sd}, 0)"})
CASES["mfi"] = Case(
    "hour", (P,),
    [{"tp": "(high + low + close) / 3"}, {"tp1": lag("tp")},
     {"up": "CASE WHEN tp > tp1 THEN tp * volume ELSE 0 END", "dn": "CASE WHEN tp < tp1 THEN tp * volume ELSE 0 END"}],
    {"mfi": f"100 * {_su} / nullif({_su} + {_sd}, 0)"})


def _share(p: int) -> str:
    return f"sum(bp) {trail(p)} / nullif(sum(r) {trail(p)}, 0)"


CASES["ultosc"] = Case(
    "hour", (2, 3, 5),
    [_tr, {"tl": "CASE WHEN rn > 1 THEN least(low, c1) END", "th": "CASE WHEN rn > 1 THEN greatest(high, c1) END"},
     {"bp": "close - tl", "r": "th - tl"}],
    {"ultosc": f"(4 * {_share(2)} + 2 * {_share(3)} + {_share(5)}) * 100 / 7"})

# -- C -------------------------------------------------------------------
_flow = {"mf": "CASE WHEN high = low THEN 0 ELSE (close - low - high + close) / (high - low) * volume END"}
CASES["ad"] = Case("hour", (), [_flow], {"ad": f"sum(mf) {CUM}"})
CASES["obv"] = Case(
    "hour", (), [_tr, {"v": "CASE WHEN close > c1 THEN volume WHEN close < c1 THEN -volume ELSE 0 END"}],
    {"obv": f"sum(v) {CUM}"})
CASES["wad"] = Case(
    "hour", (),
    [_tr, {"g": "CASE WHEN close > c1 THEN close - least(c1, low) WHEN close < c1 THEN close - greatest(c1, high) ELSE 0 END"}],
    {"wad": f"sum(g) {CUM}"})

# -- R -------------------------------------------------------------------
CASES["ema"] = Case("tick", (P,), [ema_rec(ema=("real", weight(P)))], {"ema": "ema"})
_fs = ema_rec(a=("real", weight(3)), b=("real", weight(8)))
CASES["apo"] = Case("tick", (3, 8), [_fs], {"apo": "a - b"})
CASES["ppo"] = Case("tick", (3, 8), [_fs], {"ppo": "100 * (a - b) / nullif(b, 0)"})
CASES["adosc"] = Case(
    "hour", (3, 8), [_flow, {"line": f"sum(mf) {CUM}"}, ema_rec(a=("line", weight(3)), b=("line", weight(8)))],
    {"adosc": "a - b"})
CASES["macd"] = Case(
    "tick", (12, 26, 9),
    [ema_rec(a=("real", "0.15"), b=("real", "0.075")), {"m": "a - b"}, ema_rec(26, sg=("m", weight(9)))],
    {"macd": "m", "macd_signal": "sg", "macd_histogram": "m - sg"})
CASES["dema"] = Case(
    "tick", (P,), [ema_rec(e1=("real", weight(P))), ema_rec(P, e2=("e1", weight(P)))], {"dema": "2 * e1 - e2"})
_three = [ema_rec(e1=("real", weight(P))), ema_rec(P, e2=("e1", weight(P))), ema_rec(2 * P - 1, e3=("e2", weight(P)))]
CASES["tema"] = Case("tick", (P,), _three, {"tema": "3 * e1 - 3 * e2 + e3"})
CASES["trix"] = Case(
    "tick", (P,), [*_three, {"e31": lag("e3")}], {"trix": "(e3 - e31) / nullif(e3, 0) * 100"})
CASES["zlema"] = Case(
    "tick", (P,),
    [{"x2": lag("real", 2)},
     rec({"z": "0"}, {"z": f"CASE WHEN s.rn = 2 THEN s.real ELSE (s.real + (s.real - s.x2) - r.z) * ({weight(P)}) + r.z END"})],
    {"zlema": "z"})
CASES["wilders"] = Case(
    "tick", (P,), [{"m": f"avg(real) {trail(P)}"}, wilder_rec(P, P, v=("real", "m"))], {"wilders": "v"})
_atr = [_tr, {"t": _tr_x}, {"m": f"avg(t) {trail(P)}"}, wilder_rec(P, P, v=("t", "m"))]
CASES["atr"] = Case("hour", (P,), _atr, {"atr": "v"})
CASES["natr"] = Case("hour", (P,), _atr, {"natr": "100 * v / nullif(close, 0)"}, digits=4)
_rsi = [*_ups, {"u0": f"avg(up) {trail(P)}", "d0": f"avg(dn) {trail(P)}"},
        wilder_rec(P, P + 1, u=("up", "u0"), d=("dn", "d0")), {"q": "100 * u / nullif(u + d, 0)"}]
CASES["rsi"] = Case("tick", (P,), _rsi, {"rsi": "q"})
CASES["stochrsi"] = Case(
    "tick", (P,), [*_rsi, {"hi": f"max(q) {trail(P)}", "lo": f"min(q) {trail(P)}"}],
    {"stochrsi": "CASE WHEN hi = lo THEN 0 ELSE (q - lo) / (hi - lo) END"})
_dm0 = [
    {"rise": f"high - {lag('high')}", "fall": f"{lag('low')} - low"},
    {"dp": "CASE WHEN rise > 0 AND NOT fall > rise THEN rise ELSE 0 END",
     "dn": "CASE WHEN fall > 0 AND NOT rise > fall THEN fall ELSE 0 END"},
    {"p0": f"sum(dp) {trail(P)}", "n0": f"sum(dn) {trail(P)}"},
]
_dm = [*_dm0, decayed_rec(P, up=("dp", "p0"), dw=("dn", "n0"))]
CASES["dm"] = Case("hour", (P,), _dm, {"plus_dm": "up", "minus_dm": "dw"})
CASES["di"] = Case(
    "hour", (P,),
    [_tr, {"t": f"CASE WHEN rn = 1 THEN 0 ELSE {_tr_x} END"}, *_dm0, {"t0": f"sum(t) {trail(P)}"},
     decayed_rec(P, up=("dp", "p0"), dw=("dn", "n0"), a=("t", "t0"))],
    {"plus_di": "100 * up / nullif(a, 0)", "minus_di": "100 * dw / nullif(a, 0)"})
_dx = [*_dm, {"dx": "abs(up - dw) / nullif(up + dw, 0) * 100"}]
CASES["dx"] = Case("hour", (P,), _dx, {"dx": "dx"})
_adx = [*_dx, {"m": f"avg(dx) {trail(P)}"}, wilder_rec(P, 2 * P - 1, x=("dx", "m"))]
CASES["adx"] = Case("hour", (P,), _adx, {"adx": "x"})
CASES["adxr"] = Case("hour", (P,), [*_adx, {"x4": lag("x", P - 1)}], {"adxr": "(x + x4) / 2"})
_hl1 = {"hl": "high - low"}
CASES["cvi"] = Case(
    "hour", (P,), [_hl1, ema_rec(e=("hl", weight(P))), {"e5": lag("e", P)}],
    {"cvi": "100 * (e - e5) / nullif(e5, 0)"}, digits=4)
CASES["mass"] = Case(
    "hour", (P,),
    [_hl1, ema_rec(e=("hl", weight(9))), ema_rec(9, e2=("e", weight(9))), {"q": "e / nullif(e2, 0)"}],
    {"mass": f"CASE WHEN count(q) {trail(P)} = {P} THEN sum(q) {trail(P)} END"})
CASES["kama"] = Case(
    "tick", (P,),
    [_step, {"mv": "abs(real - x1)", "far": f"abs(real - {lag('real', P)})"}, {"sm": f"sum(mv) {trail(P)}"},
     {"sc": "pow(CASE WHEN sm = 0 THEN 1 ELSE far / sm END * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2)"},
     rec({"k": "0"}, {"k": f"CASE WHEN s.rn < {P} THEN 0 WHEN s.rn = {P} THEN s.real ELSE r.k + s.sc * (s.real - r.k) END"})],
    {"kama": "k"})
CASES["vidya"] = Case(
    "tick", (2, 5, 0.2),
    [{"a": f"stddev_pop(real) {trail(2)}", "b": f"stddev_pop(real) {trail(5)}"},
     {"k": "coalesce(a / nullif(b, 0), 0) * 0.2"},
     rec({"v": "0"}, {"v": "CASE WHEN s.rn < 4 THEN 0 WHEN s.rn = 4 THEN s.real ELSE (s.real - r.v) * s.k + r.v END"})],
    {"vidya": "v"})


def _volume_index(compare: str) -> list:
    grow = f"CASE WHEN s.volume {compare} s.v1 THEN r.x + (s.close - s.c1) / s.c1 * r.x ELSE r.x END"
    return [{"c1": lag("close"), "v1": lag("volume")}, rec({"x": "1000"}, {"x": grow})]


# The index drifts over many orders of magnitude, so its logarithm is compared.
CASES["nvi"] = Case("hour", (), _volume_index("<"), {"ln_nvi": "ln(x)"},
                    finish=lambda df: df.withColumn("ln_nvi", F.ln("nvi")).drop("nvi"))
CASES["pvi"] = Case("hour", (), _volume_index(">"), {"ln_pvi": "ln(x)"},
                    finish=lambda df: df.withColumn("ln_pvi", F.ln("pvi")).drop("pvi"))
CASES["decay"] = Case(
    "tick", (P,), [rec({"v": "s.real"}, {"v": f"greatest(s.real, r.v - 1.0 / {P})"})], {"decay": "v"})
CASES["edecay"] = Case(
    "tick", (P,), [rec({"v": "s.real"}, {"v": f"greatest(s.real, r.v * (1 - 1.0 / {P}))"})], {"edecay": "v"})
CASES["kvo"] = Case(
    "day", (3, 8),
    [{"hlc": "high + low + close", "w": "high - low"}, {"hlc1": lag("hlc"), "w1": lag("w")},
     rec({"tr": "0"}, {"tr": "CASE WHEN s.hlc > s.hlc1 THEN 1 WHEN s.hlc < s.hlc1 THEN -1 ELSE r.tr END"}),
     {"tr1": lag("tr")},
     rec({"cm": "0"}, {"cm": "CASE WHEN s.tr <> s.tr1 THEN s.w1 ELSE r.cm END + s.w"}),
     {"f": "volume * abs(w / nullif(cm, 0) * 2 - 1) * 100 * CASE WHEN tr < 0 THEN -1 ELSE 1 END"},
     ema_rec(2, a=("f", weight(3)), b=("f", weight(8)))],
    {"kvo": "a - b"}, digits=4)
_fish = [
    {"mid": "(high + low) / 2"}, {"hi": f"max(mid) {trail(P)}", "lo": f"min(mid) {trail(P)}"},
    {"u": "0.33 * 2 * ((mid - lo) / CASE WHEN hi = lo THEN 0.001 ELSE hi - lo END - 0.5)"},
    rec({"v": "0"}, {"v": f"CASE WHEN s.rn < {P} THEN 0 WHEN s.u + 0.67 * r.v > 0.99 THEN 0.999 "
                          "WHEN s.u + 0.67 * r.v < -0.99 THEN -0.999 ELSE s.u + 0.67 * r.v END"}),
    rec({"f": "0"}, {"f": f"CASE WHEN s.rn < {P} THEN 0 ELSE 0.5 * ln((1 + s.v) / (1 - s.v)) + 0.5 * r.f END"}),
    {"f1": lag("f")},
]
CASES["fisher"] = Case("hour", (P,), _fish, {"fisher": "f", "fisher_signal": "f1"})


def psar_sql(unit: float, limit: float) -> str:
    """Written out in full: its state has four fields that depend on each other within a step."""
    base = chain("hour", [{"h1": lag("high"), "l1": lag("low"), "h2": lag("high", 2), "l2": lag("low", 2)}], {"x": "rn"})
    head = base[: base.rindex("\nSELECT")]
    return f"""{head},
p AS (
  SELECT sym, ts, rn, high, low, CAST(NULL AS DOUBLE) AS sar, CAST(NULL AS DOUBLE) AS ext,
         CAST({unit} AS DOUBLE) AS acc, true AS lng, CAST(NULL AS DOUBLE) AS shown
  FROM s1 WHERE rn = 1
  UNION ALL
  SELECT sym, ts, rn, high, low, CASE WHEN flip THEN e2 ELSE sar2 END,
         CASE WHEN NOT flip THEN e2 WHEN l0 THEN low ELSE high END,
         CASE WHEN flip THEN {unit} ELSE a2 END, CASE WHEN flip THEN NOT l0 ELSE l0 END,
         CASE WHEN flip THEN e2 ELSE sar2 END
  FROM (SELECT *, (l0 AND low < sar2) OR (NOT l0 AND high > sar2) AS flip FROM (
    SELECT *,
      CASE WHEN l0 THEN least(sar1, l1, coalesce(l2, sar1)) ELSE greatest(sar1, h1, coalesce(h2, sar1)) END AS sar2,
      CASE WHEN (l0 AND high > e0) OR (NOT l0 AND low < e0) THEN least(a0 + {unit}, {limit}) ELSE a0 END AS a2,
      CASE WHEN l0 THEN greatest(e0, high) ELSE least(e0, low) END AS e2
    FROM (SELECT *, (e0 - s00) * a0 + s00 AS sar1 FROM (
      SELECT s.*, p.acc AS a0,
        CASE WHEN s.rn = 2 THEN s.h1 + s.l1 <= s.high + s.low ELSE p.lng END AS l0,
        CASE WHEN s.rn > 2 THEN p.ext WHEN s.h1 + s.l1 <= s.high + s.low THEN s.h1 ELSE s.l1 END AS e0,
        CASE WHEN s.rn > 2 THEN p.sar WHEN s.h1 + s.l1 <= s.high + s.low THEN s.l1 ELSE s.h1 END AS s00
      FROM p JOIN s1 s ON s.sym = p.sym AND s.rn = p.rn + 1)))))
SELECT sym, ts, round(shown, 6) + 0.0 AS psar FROM p WHERE rn > 1"""


CASES["psar"] = Case("hour", (0.02, 0.2))


def run_case(spark: SparkSession, sf_dir: str, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    case = CASES[name]
    inputs = {k: v() for k, v in case.inputs.items()}
    if case.source == "tick":
        df = compute(name, ticks(spark, sf_dir), case.options, order=("ts", "event_id"), inputs=inputs,
                     grain=TICK_GRAIN, chunk_rows=chunk_rows)
        df = df.drop("ts")
    else:
        df = compute(name, bars(spark, sf_dir, case.source, keep=REGISTRY[name].family != "P"), case.options, inputs=inputs,
                     grain=BAR_GRAIN, chunk_rows=chunk_rows)
    df = case.finish(df) if case.finish else df
    return rounded(df, [c for c in df.columns if c not in ("sym", "ts", "event_id")], case.digits)


def case_sql(name: str) -> str:
    case = CASES[name]
    if name == "psar":
        return psar_sql(*case.options)
    return chain(case.source, case.stages, case.outputs, REGISTRY[name].start(*case.options), case.digits)


def queries() -> dict:
    def make(name):
        return lambda spark, sf_dir: run_case(spark, sf_dir, name)

    return {f"ind_{name}": make(name) for name in REGISTRY}


def oracle_sql() -> dict[str, str]:
    return {f"ind_{name}": case_sql(name) for name in REGISTRY}
