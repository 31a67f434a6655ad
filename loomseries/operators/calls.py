"""A call per row to a service that may fail, with JSON answers.

The calls of a task run side by side, under a rate limit of the task. A call
that raises, or whose answer is no JSON or fails the check, is repeated after a
wait that doubles. If no attempt succeeds, the last answer that was JSON is
returned all the same, marked as partial.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*\n(.*?)\n?\s*```\s*$", re.S)


class Pace:
    """Lets calls through at most so many times a second; None: as they come."""

    def __init__(self, per_second: float | None):
        self.gap, self.next, self.lock = (1.0 / per_second if per_second else 0.0), 0.0, threading.Lock()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                now = time.monotonic()
                at = max(now, self.next)
                self.next = at + self.gap
            time.sleep(at - now)


def ask(
    value: str | None, call: Callable[[str | None, int], str | None], check: Callable[[object], bool], attempts: int, first_wait: float, pace: Pace
) -> tuple[str | None, str, int]:
    """The answer's JSON as text, its state (ok, partial, failed), and the number of calls."""
    last = None
    for attempt in range(attempts):
        try:
            pace.wait()
            answer = call(value, attempt) or ""
            fenced = FENCE.match(answer)
            found = json.loads(fenced.group(1) if fenced else answer)
            last = json.dumps(found, ensure_ascii=False, sort_keys=True)
            if check(found):
                return last, "ok", attempt + 1
        except Exception:  # whatever a client raises counts as a failed attempt
            pass
        if attempt + 1 < attempts:
            time.sleep(first_wait * 2**attempt)
    return last, "partial" if last is not None else "failed", attempts


def call_json(
    df: DataFrame, argument: str, call: Callable[[str | None, int], str | None], check: Callable[[object], bool], out: str,
    attempts: int = 3, first_wait: float = 1.0, at_once: int = 8, per_second: float | None = None,
) -> DataFrame:
    """Add ``out`` (JSON text or NULL), ``out_state`` and ``out_calls`` to every row.

    ``call`` gets the argument (maybe NULL) and the number of the attempt, from
    0. A task that is run again calls again; rows that a task has in work are at
    most a batch, and calls at once at most ``at_once``.
    """
    extra = [T.StructField(out, T.StringType()), T.StructField(f"{out}_state", T.StringType()), T.StructField(f"{out}_calls", T.LongType())]
    place = df.columns.index(argument)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(per_second)
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                values = batch.column(place).to_pylist()
                answers = list(pool.map(lambda v: ask(v, call, check, attempts, first_wait, pace), values))
                columns = [pa.array([a[i] for a in answers], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f.name for f in extra)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra]))
