"""A keyed, ordered series cut into chunks of bounded length.

Every window of the indicator library runs over ``(key, chunk)`` instead of
``key``, so one dominant key is spread over many tasks. A frame that reaches
``n`` rows back needs the last ``n`` rows of the chunk before: ``span(n)``
copies exactly those rows into the next chunk, and ``owned()`` drops the copies
once the frames are evaluated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .numbering import number_rows

CHUNK_ROWS = 65_536


class _Columns:
    """``c.high`` is ``F.col("high")``, made when used because columns need a running session."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


c = _Columns()


@dataclass(frozen=True)
class Series:
    df: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    chunk_rows: int = CHUNK_ROWS
    halo: int = 0

    @classmethod
    def of(
        cls,
        df: DataFrame,
        key: Sequence[str],
        order: Sequence[str],
        grain: int,
        chunk_rows: int = CHUNK_ROWS,
    ) -> "Series":
        numbered = number_rows(df, key, order, grain)
        chunk = F.expr(f"(rn - 1) div {int(chunk_rows)}")
        return cls(numbered.withColumn("chunk", chunk), tuple(key), tuple(order), chunk_rows)

    # -- frames ---------------------------------------------------------
    @property
    def group(self) -> list[str]:
        return [*self.key, "chunk"]

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy("rn")

    def trail(self, n: int) -> WindowSpec:
        """The current row and the ``n - 1`` rows before it."""
        return self.w.rowsBetween(-(n - 1), 0)

    def prev(self, n: int) -> WindowSpec:
        """The ``n`` rows before the current row."""
        return self.w.rowsBetween(-n, -1)

    def lag(self, column: Column | str, n: int = 1) -> Column:
        return F.lag(column, n).over(self.w)

    # -- shape ----------------------------------------------------------
    def add(self, **columns: Column) -> "Series":
        return replace(self, df=self.df.withColumns(columns))

    def span(self, n: int) -> "Series":
        """Copy the last ``n`` rows before each chunk into it; they may come from several chunks."""
        if n <= self.halo:
            return self
        base = self.owned()
        # A row at place p of its chunk is among the last n rows before the i-th chunk after it if p >= i * chunk_rows - n.
        place = (F.col("rn") - 1) % F.lit(self.chunk_rows)
        ahead = F.floor((place + F.lit(n)) / F.lit(self.chunk_rows)).cast("long")
        homes = F.sequence(F.col("chunk"), F.col("chunk") + ahead)
        copied = (
            base.df.withColumn("_home", F.col("chunk"))
            .withColumn("chunk", F.explode(homes))
            .withColumn("_own", F.col("chunk") == F.col("_home"))
            .drop("_home")
        )
        return replace(base, df=copied, halo=n)

    def owned(self) -> "Series":
        if not self.halo:
            return self
        return replace(self, df=self.df.filter("_own").drop("_own"), halo=0)

    # -- running totals -------------------------------------------------
    def _with_carried(self, carried: DataFrame) -> "Series":
        """One row more per chunk, ahead of its rows (its ``rn`` is NULL), with what earlier chunks hand on."""
        return replace(self, df=self.df.unionByName(carried, allowMissingColumns=True))

    def running_sum(self, **terms: Column) -> "Series":
        """Sum from the first row of the key: the total of earlier chunks and the rows of the chunk so far."""
        base = self.owned().add(**{f"_t_{k}": v for k, v in terms.items()})
        totals = base.df.groupBy(*self.group).agg(*[F.sum(f"_t_{k}").alias(f"_c_{k}") for k in terms])
        before = Window.partitionBy(*self.key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(*self.group, *[F.sum(f"_c_{k}").over(before).alias(f"_t_{k}") for k in terms])
        upto = self.w.rowsBetween(Window.unboundedPreceding, 0)
        done = base._with_carried(carried).add(**{k: F.sum(f"_t_{k}").over(upto) for k in terms})
        return replace(base, df=done.df.filter("rn IS NOT NULL").drop(*[f"_t_{k}" for k in terms]))

    # -- carried values -------------------------------------------------
    def running_last(self, **columns: Column) -> "Series":
        """The newest value so far that is not NULL, this row included."""
        base = self.owned().add(**{f"_t_{k}": v for k, v in columns.items()})
        ends = base.df.groupBy(*self.group).agg(
            *[F.max_by(f"_t_{k}", F.when(F.col(f"_t_{k}").isNotNull(), F.col("rn"))).alias(f"_c_{k}") for k in columns]
        )
        before = Window.partitionBy(*self.key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(
            *self.group, *[F.last(f"_c_{k}", ignorenulls=True).over(before).alias(f"_t_{k}") for k in columns]
        )
        upto = self.w.rowsBetween(Window.unboundedPreceding, 0)
        done = base._with_carried(carried).add(**{k: F.last(f"_t_{k}", ignorenulls=True).over(upto) for k in columns})
        return replace(base, df=done.df.filter("rn IS NOT NULL").drop(*[f"_t_{k}" for k in columns]))


def ratio(top: Column, bottom: Column) -> Column:
    """Division where x/0 is NULL instead of an error or an infinity."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def fir(s: Series, column: str, weights: Sequence[float]) -> Column:
    """Fixed weights over the trailing rows; the last weight is for the current row."""
    n = len(weights)
    if n <= 32:
        terms = [F.col(column) * F.lit(float(weights[-1]))]
        terms += [s.lag(column, j) * F.lit(float(weights[n - 1 - j])) for j in range(1, n)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total
    values = F.collect_list(column).over(s.trail(n))
    weighted = F.zip_with(values, F.array(*[F.lit(float(v)) for v in weights]), lambda a, b: a * b)
    return F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v)
