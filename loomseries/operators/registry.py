"""Indicator registry: name -> inputs, options, outputs, warm-up and builder."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.series import CHUNK_ROWS, Series


@dataclass(frozen=True)
class Indicator:
    name: str
    full_name: str
    kind: str  # simple, math, indicator or overlay
    family: str  # P pointwise, L lag, W frame, C running total, R recursion
    inputs: tuple[str, ...]
    options: tuple[str, ...]
    outputs: tuple[str, ...]
    build: Callable
    start: Callable[..., int]  # leading rows without output
    check: Callable[..., bool]  # are these option values valid?


REGISTRY: dict[str, Indicator] = {}


def indicator(name, full_name, kind, family, inputs, outputs, options=(), start=0, check=None):
    """Register the decorated builder under ``name``."""
    first = start if callable(start) else (lambda *_: start)
    valid = check or (lambda *values: all(v >= 1 for v in values))

    def register(build):
        REGISTRY[name] = Indicator(
            name, full_name, kind, family,
            tuple(inputs.split()), tuple(options.split()) if options else (), tuple(outputs.split()),
            build, first, valid,
        )
        return build

    return register


def indicator_count() -> int:
    return len(REGISTRY)


def find_indicator(name: str) -> Indicator | None:
    return REGISTRY.get(name)


def warm_up(name: str, *options: float) -> int:
    """Number of leading rows of each key that have no output."""
    return REGISTRY[name].start(*options)


def require(name: str, options: Sequence[float]) -> Indicator:
    entry = REGISTRY.get(name)
    if entry is None:
        raise KeyError(f"no indicator named {name!r}")
    if len(options) != len(entry.options):
        raise ValueError(f"{name} takes options {entry.options}, got {list(options)}")
    if not entry.check(*options):
        raise ValueError(f"invalid options for {name}: {dict(zip(entry.options, options))}")
    return entry


def compute(
    name: str,
    df: DataFrame,
    options: Sequence[float] = (),
    key: Sequence[str] = ("sym",),
    order: Sequence[str] = ("ts",),
    inputs: Mapping[str, str | Column] | None = None,
    grain: int = 60_000_000,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Run one indicator over every key of ``df``.

    ``inputs`` maps the indicator's input names to columns of (or over) ``df``; names
    left out are taken as column names. Rows of the warm-up are not emitted.
    ``grain`` is the width of the buckets used for row numbers (microseconds
    of the first order column); one bucket of one key should fit a task.
    """
    entry = require(name, options)
    source = dict(inputs or {})
    given = {i: source.get(i, i) for i in entry.inputs}
    columns = {i: F.col(v) if isinstance(v, str) else v for i, v in given.items()}
    picked = df.select(*key, *order, *[v.cast("double").alias(i) for i, v in columns.items()])
    keep = [*key, *order, *entry.outputs]
    if entry.family == "P":
        return picked.withColumns(dict(zip(entry.outputs, entry.build(*options)))).select(*keep)
    s = Series.of(picked, key, order, grain, chunk_rows)
    done: Series = entry.build(s, *options)
    start = entry.start(*options)
    out = done.owned().df
    return (out.filter(F.col("rn") > start) if start > 0 else out).select(*keep)
