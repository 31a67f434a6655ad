"""Non-preemptive priority scheduling of independent queues."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.series import CHUNK_ROWS, Series
from .scan import Step, by_group, doubles, fields_of, scan


def priority_schedule(
    jobs: DataFrame, key: Sequence[str], grain: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Completion, turn-around and waiting time of jobs ``(key, id, at, bt, priority)``.

    A free server takes the arrived job of the smallest priority (then earliest
    arrival, then id) and jumps over idle time. When the server is busy depends
    on the amount of work only, not on its order: that is the recursion
    end = max(at, end before) + bt, which ``scan`` runs in parallel. Its idle
    gaps cut a queue into busy periods that are scheduled independently.
    """
    s = Series.of(jobs.select(*key, "id", "at", "bt", "priority"), key, ["at", "id"], grain, chunk_rows)
    arrive, work = F.col("at").cast("double"), F.col("bt").cast("double")
    s = scan(s, end=Step(F.lit(1.0), work, arrive + work)).span(1)
    s = s.add(opens=(F.col("rn") == 1) | (F.col("at") >= s.lag("end")))
    # A busy period goes to the chunk it starts in.
    s = s.owned().add(home=F.when(F.col("opens"), F.col("chunk")))
    s = s.running_last(home=F.col("home"))
    fields = fields_of(s.df, (*key, "id", "at", "bt", "priority"))
    names = [f.name for f in fields]

    def serve(at: list, bt: list, pr: list) -> list:
        """Completion times of one busy period, in order of arrival."""
        done, waiting, i, now = [0.0] * len(at), [], 0, at[0]
        for _ in at:
            while i < len(at) and at[i] <= now:
                heapq.heappush(waiting, (pr[i], i))
                i += 1
            _, job = heapq.heappop(waiting)
            now += bt[job]
            done[job] = now
        return done

    def serve_periods(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts = [*np.flatnonzero(pdf["opens"].to_numpy()).tolist(), len(pdf)]
        at, bt, pr = (pdf[n].tolist() for n in ("at", "bt", "priority"))
        done = []
        for lo, hi in zip(cuts, cuts[1:]):
            done += serve(at[lo:hi], bt[lo:hi], pr[lo:hi])
        out = pdf[names].copy()
        out["ct"] = np.array(done, dtype=float)
        out["tat"] = out["ct"] - out["at"]
        out["wt"] = out["tat"] - out["bt"]
        return out

    def serve_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []  # rows of the period that is still open
        for pdf in batches:
            if pdf.empty:
                continue
            cuts = np.flatnonzero(pdf["opens"].to_numpy())
            if not held and not (len(cuts) and cuts[0] == 0):
                raise RuntimeError("a busy period was split over two tasks")
            if len(cuts) and (held or cuts[-1] > 0):
                yield serve_periods(pd.concat([*held, pdf.iloc[: cuts[-1]]]))
                held = []
            held.append(pdf.iloc[cuts[-1] :] if len(cuts) else pdf)
        if held:
            yield serve_periods(pd.concat(held))

    schema = T.StructType(fields + doubles(("ct", "tat", "wt")))
    return by_group(s.df, [*key, "home"], "rn").mapInPandas(serve_all, schema)


def schedule_averages(scheduled: DataFrame, key: Sequence[str]) -> DataFrame:
    return scheduled.groupBy(*key).agg(*[F.avg(c).alias(f"avg_{c}") for c in ("ct", "tat", "wt")])
