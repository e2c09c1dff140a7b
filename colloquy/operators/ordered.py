"""Order-dependent operators that do not depend on one key fitting one task.

``arrange`` looks at the longest key first. If every key is short, the rows stay
where they are and each operator is one plain window per key. If a key is long,
the rows are range-partitioned by (key, order), which cuts a long key into many
partitions of like size, and numbered into *runs*: stretches of at most
``run_rows`` consecutive rows of a key. An operator then works inside each run and
adds what earlier runs carry over, a table with one row per run.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.runtime import materialize

RUN = "_run"
RUN_ROWS = 100_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number below bit 33


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Ordered:
    """Rows with a key, a total order and a run number."""

    df: DataFrame
    key: list
    order: list
    split: bool
    run_rows: int = RUN_ROWS
    longest: int = 0

    def with_df(self, df: DataFrame, order=None) -> "Ordered":
        """The same runs over rows derived from these (``_run`` must be kept)."""
        return replace(self, df=df, order=_names(order) if order else self.order)

    def result(self) -> DataFrame:
        return self.df.drop(RUN)

    @property
    def group(self) -> list:
        return [*self.key, RUN] if self.split else list(self.key)

    def window(self, descending: bool = False):
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.group).orderBy(*order)

    def _place(self) -> Column:
        return F.struct(*self.order)

    def _carry(self, per_run: Column, over, descending: bool = False) -> DataFrame:
        """One row per run with what the runs before (or after) it leave behind."""
        totals = self.df.groupBy(*self.key, RUN).agg(per_run.alias("_own"))
        runs = Window.partitionBy(*self.key).orderBy(F.col(RUN).desc() if descending else F.col(RUN))
        runs = runs.rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*self.key, RUN, over(F.col("_own")).over(runs).alias("_carried")).where(
            F.col("_carried").isNotNull()
        )

    def _attach(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        names = [*self.key, RUN]
        side = carry.select(*[F.col(c).alias(f"_c_{c}") for c in names], "_carried")
        match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in names])
        return df.join(side, match, "left").drop(*[f"_c_{c}" for c in names])

    def running_sum(self, value, out: str) -> "Ordered":
        """Sum of ``value`` up to and including the row."""
        frame = self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = self.df.withColumn(out, F.sum(value).over(frame))
        if self.split:
            carry = self._carry(F.sum(value), F.sum)
            df = self._attach(df, carry)
            df = df.withColumn(out, F.coalesce(F.col("_carried") + F.col(out), F.col(out), F.col("_carried")))
            df = df.drop("_carried")
        return self.with_df(df)

    def last_value(self, value, out: str, current: bool = True, backwards: bool = False) -> "Ordered":
        """The nearest non-null ``value`` at or before the row.

        ``current=False`` leaves the row itself out; ``backwards=True`` looks at
        the rows after it instead.
        """
        value = _col(value)
        frame = self.window(backwards).rowsBetween(
            Window.unboundedPreceding, Window.currentRow if current else -1
        )
        df = self.df.withColumn(out, F.last(value, ignorenulls=True).over(frame))
        if self.split:
            pick = F.min_by if backwards else F.max_by
            place = F.when(value.isNotNull(), self._place())
            carry = self._carry(
                pick(value, place), lambda c: F.last(c, ignorenulls=True), descending=backwards
            )
            df = self._attach(df, carry).withColumn(out, F.coalesce(out, "_carried")).drop("_carried")
        return self.with_df(df)

    def next_value(self, value, out: str, current: bool = True) -> "Ordered":
        """The nearest non-null ``value`` at or after the row.

        Runs over the descending order: a growing frame is linear there, while
        a frame that shrinks towards the end is recomputed for every row.
        """
        return self.last_value(value, out, current, backwards=True)

    def lag(self, value, out: str) -> "Ordered":
        """``value`` of the row before, null in front of the first."""
        boxed = self.last_value(F.struct(_col(value).alias("v")), out, current=False)
        return self.with_df(boxed.df.withColumn(out, F.col(out)["v"]))

    def lead(self, value, out: str) -> "Ordered":
        boxed = self.next_value(F.struct(_col(value).alias("v")), out, current=False)
        return self.with_df(boxed.df.withColumn(out, F.col(out)["v"]))


def longest_key(df: DataFrame, key) -> int:
    """Rows of the longest key; a partial count over the key columns only."""
    return df.groupBy(*_names(key)).count().agg(F.max("count")).first()[0] or 0


def arrange(df: DataFrame, key, order, run_rows: int = RUN_ROWS, bound: int | None = None) -> Ordered:
    """Prepare ``df`` for ordered operators; ``key`` may be empty.

    ``bound`` is a known upper limit for the rows of a key, which saves the count
    if it is small.
    """
    key, order = _names(key), _names(order)
    longest = bound if bound is not None and bound <= run_rows else longest_key(df, key)
    if longest <= run_rows:
        return Ordered(df.withColumn(RUN, F.lit(0).cast("bigint")), key, order, False, run_rows, longest)
    row = F.monotonically_increasing_id()
    part = F.shiftright(row, _ROW_BITS)
    within = row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    stretch = F.floor(within / run_rows)
    ranked = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    numbered = ranked.withColumn(RUN, (part * (1 << 24) + stretch).cast("bigint"))
    return Ordered(materialize(numbered), key, order, True, run_rows, longest)
