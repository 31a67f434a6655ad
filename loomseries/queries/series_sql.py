"""Building blocks of the comparison SQL for series queries."""

from __future__ import annotations

BAR_SQL = """bars AS (
  SELECT event_type AS sym, date_trunc('{unit}', ts) AS bar_ts,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2),
s0 AS (SELECT sym, bar_ts AS ts, open, high, low, close, volume,
              row_number() OVER (PARTITION BY sym ORDER BY bar_ts) AS rn FROM bars)"""

TICK_SQL = """s0 AS (SELECT event_type AS sym, event_id, value AS real, CAST(user_id AS DOUBLE) AS real2,
              row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)"""

SOURCES = {
    "hour": (BAR_SQL.format(unit="hour"), ["sym", "ts"]),
    "day": (BAR_SQL.format(unit="day"), ["sym", "ts"]),
    "tick": (TICK_SQL, ["sym", "event_id"]),
}


def trail(p: int) -> str:
    return f"OVER (PARTITION BY sym ORDER BY rn ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


def prev(p: int) -> str:
    return f"OVER (PARTITION BY sym ORDER BY rn ROWS BETWEEN {p} PRECEDING AND 1 PRECEDING)"


ORD = "OVER (PARTITION BY sym ORDER BY rn)"
CUM = "OVER (PARTITION BY sym ORDER BY rn ROWS UNBOUNDED PRECEDING)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {ORD}"


def rec(init: dict[str, str], step: dict[str, str]) -> tuple[dict, dict]:
    """A row-by-row recursion: ``r.`` is the row before, ``s.`` the current one."""
    return (init, step)


def chain(source: str, stages: list, outputs: dict[str, str], start: int = 0, digits: int = 6) -> str:
    """Stages of added columns over a source; the outputs are rounded, rows up to ``start`` left out."""
    base, ids = SOURCES[source]
    parts, last = [base], "s0"
    stages = [*stages, {f"out_{n}": x for n, x in outputs.items()}]  # windows see the warm-up rows too
    for number, stage in enumerate(stages, 1):
        name = f"s{number}"
        if isinstance(stage, dict):
            added = ", ".join(f"{x} AS {n}" for n, x in stage.items())
            parts.append(f"{name} AS (SELECT *, {added} FROM {last})")
        else:
            init, step = stage
            first = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in init.items())
            then = ", ".join(f"CAST({step[n]} AS DOUBLE) AS {n}" for n in init)
            parts.append(
                f"{name} AS (SELECT s.*, {first} FROM {last} s WHERE s.rn = 1 UNION ALL "
                f"SELECT s.*, {then} FROM {name} r JOIN {last} s ON s.sym = r.sym AND s.rn = r.rn + 1)"
            )
        last = name
    shown = ", ".join(f"round(out_{n}, {digits}) + 0.0 AS {n}" for n in outputs)
    return (
        "WITH RECURSIVE " + ",\n".join(parts)
        + f"\nSELECT {', '.join(ids)}, {shown} FROM {last} WHERE rn > {start}"
    )
