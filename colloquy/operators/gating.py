"""Greedy acceptance: a row is accepted if the last accepted one is over.

Each row says until when it keeps its key busy. The first row of a key is
accepted; the next accepted row is the first one at or after that moment, and so
on. Debounce and the busy gate are both this operator.

A key that fits one run is walked in one array. A longer key is walked in all its
runs at once: every run first works out, for each possible entry, at which moment
a walk leaves it. Those moments form a forest of "left here, entered there"
edges, in which the moments really passed are found by doubling (log of the
number of runs). Each run is then walked once from its known entry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.numbers import micros
from colloquy.operators.ordered import RUN, RUN_ROWS, Ordered, arrange
from colloquy.runtime import materialize

_NEVER = np.iinfo(np.int64).max


def _following(ts: np.ndarray, until: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(ts, until, side="left"), np.arange(1, len(ts) + 1))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _walk(ts: pd.Series, until: pd.Series, entry: pd.Series) -> pd.Series:
    def one(t, u, first):
        t, u = np.asarray(t, dtype=np.int64), np.asarray(u, dtype=np.int64)
        nxt, i, taken = _following(t, u), int(np.searchsorted(t, first, side="left")), []
        while i < len(t):
            taken.append(i)
            i = int(nxt[i])
        return taken

    return pd.Series([one(*row) for row in zip(ts, until, entry)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _exits(ts: pd.Series, until: pd.Series) -> pd.Series:
    """For each entry row, the busy moment a walk from it leaves the run with."""
    def one(t, u):
        t, u = np.asarray(t, dtype=np.int64), np.asarray(u, dtype=np.int64)
        n = len(t)
        nxt = np.append(_following(t, u), n)
        last = np.append(np.arange(n), n)
        # pointer doubling inside the run: last[i] ends on the final accepted row
        hop = nxt.copy()
        while (hop[:n] < n).any():
            inside = hop < n
            last = np.where(inside, last[np.minimum(hop, n)], last)
            hop = hop[hop]
        return u[last[:n]]

    return pd.Series([one(t, u) for t, u in zip(ts, until)])


def accept(rows: Ordered, until: str) -> Ordered:
    """Accepted rows, still in their runs.

    ``rows.order[0]`` and ``until`` are microseconds or numbers; ``until`` null means the row keeps its key busy for good.
    """
    ts = rows.order[0]
    kept = [c for c in rows.df.columns if c not in (*rows.key, RUN)]
    item = F.struct(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(rows.order)],
        F.coalesce(F.col(until), F.lit(int(_NEVER))).alias("_until"),
    )
    # the key as one struct: joins on it keep null keys
    runs = rows.df.groupBy(F.struct(*rows.key).alias("_key"), RUN).agg(F.collect_list(item).alias("_rows"), F.collect_list(F.struct(*kept)).alias("_all"))
    # whole rows are not compared, so columns of any type will do; both lists are in one order
    runs = runs.withColumn("_rows", F.array_sort(F.transform("_rows", lambda x, i: x.withField("_i", i))))
    if rows.split:
        runs = materialize(runs)
        runs = runs.join(_entries(runs, ["_key"]), ["_key", RUN])
    else:
        runs = runs.withColumn("_entry", F.lit(int(np.iinfo(np.int64).min)))
    taken = _walk(F.col("_rows._o0"), F.col("_rows._until"), F.col("_entry"))
    picked = runs.withColumn("_taken", taken).select(
        "_key", RUN, F.explode(F.transform("_taken", lambda i: F.get(F.col("_all"), F.get(F.col("_rows"), i)["_i"]))).alias("_row")
    )
    return rows.with_df(picked.select("_key.*", RUN, "_row.*").select(*rows.df.columns))


def _entries(runs: DataFrame, key: list) -> DataFrame:
    """The moment from which each visited run is entered."""
    by_run = Window.partitionBy(*key).orderBy(RUN)
    spans = runs.select(*key, RUN, F.element_at("_rows._o0", -1).alias("_end")).select(
        "*", F.lead(RUN).over(by_run).alias("_next"), F.row_number().over(by_run).alias("_no"),
        F.count("*").over(Window.partitionBy(*key)).alias("_of"),
    )
    spans = materialize(spans)
    opening = spans.where("_no = 1").select(*key, RUN, F.lit(int(np.iinfo(np.int64).min)).alias("_entry"))
    longest = spans.agg(F.max("_of")).first()[0] or 1
    if longest == 1:
        return opening
    spans = spans.where("_of > 1")  # keys of one run are done
    runs = materialize(
        runs.join(spans.select(*key, RUN, "_next", "_no"), [*key, RUN]).select(
            *key, RUN, "_next", "_no",
            F.col("_rows._o0").alias("_ts"),
            _exits(F.col("_rows._o0"), F.col("_rows._until")).alias("_out"),
        )
    )

    # a node is (key, run left, moment); it enters the first later row at or after
    # the moment, found by filling backwards over moments and rows in one order
    after = runs.select(
        *key, RUN, "_next", F.lead(F.element_at("_out", 1)).over(by_run).alias("_past")
    ).where("_next IS NOT NULL")
    nodes = runs.select(*key, RUN, F.explode(F.array_distinct("_out")).alias("_v")).join(after, [*key, RUN])
    marks = nodes.withColumn("_kind", F.lit(0)).withColumn("_i", F.lit(0))
    rows = runs.select(*key, RUN, F.posexplode(F.arrays_zip("_ts", "_out")).alias("_i", "_r")).select(
        *key, RUN, F.col("_r._ts").alias("_v"), F.lit(1).alias("_kind"), "_i",
        F.struct(F.col(RUN).alias("run"), F.col("_r._out").alias("exit")).alias("_hit"),
    )
    merged = arrange(
        marks.unionByName(rows, allowMissingColumns=True).withColumnRenamed(RUN, "_from"), key, ["_v", "_kind", "_from", "_i"]
    ).next_value("_hit", "_got")
    further = F.col("_got.run") >= F.col("_next")  # false for a row that is busy no longer than its own moment
    edges = materialize(
        merged.result().where("_kind = 0 AND _got IS NOT NULL").select(
            *key, "_from", F.col("_v").alias("_at"),
            F.when(further, F.col("_got.run")).otherwise(F.col("_next")).alias("_to"),
            F.when(further, F.col("_got.exit")).otherwise(F.col("_past")).alias("_left"),
        )
    )
    start = runs.where("_no = 1").select(
        *key, F.col(RUN).alias("_from"), F.element_at("_out", 1).alias("_at")
    )
    reached = materialize(start)
    jump = edges.select(*key, "_from", "_at", F.col("_to").alias("_from2"), F.col("_left").alias("_at2"))
    steps = 1
    while steps < longest:
        moved = reached.join(jump, [*key, "_from", "_at"]).select(
            *key, F.col("_from2").alias("_from"), F.col("_at2").alias("_at")
        )
        reached = materialize(reached.unionByName(moved).distinct())
        steps *= 2
        if steps < longest:
            far = jump.select(*key, F.col("_from").alias("_from2"), F.col("_at").alias("_at2"),
                              F.col("_from2").alias("_from3"), F.col("_at2").alias("_at3"))
            jump = materialize(
                jump.join(far, [*key, "_from2", "_at2"]).select(
                    *key, "_from", "_at", F.col("_from3").alias("_from2"), F.col("_at3").alias("_at2")
                )
            )
    later = edges.join(reached, [*key, "_from", "_at"]).select(
        *key, F.col("_to").alias(RUN), F.col("_at").alias("_entry")
    )
    return opening.unionByName(later)


def debounce(
    df: DataFrame, key, ts: str, score: str, threshold: float, gap: float, tie=(), run_rows: int = RUN_ROWS
) -> DataFrame:
    """Rows with ``score >= threshold`` at least ``gap`` seconds after the last emitted.

    One timer runs per ``key``, whatever model the score comes from. Rows without a time are left out.
    """
    over = df.where(F.col(score) >= threshold).withColumn("_at", micros(df, ts))
    return gate(over, key, gap, tie, run_rows)


def gate_triggers(df: DataFrame, key, ts: str, busy_for, tie=(), run_rows: int = RUN_ROWS) -> DataFrame:
    """Triggers accepted while nothing is running.

    ``busy_for`` is a number of seconds or a column with the seconds each
    accepted trigger keeps its key busy, for good where it is null. Rows without a time are left out.
    """
    return gate(df.withColumn("_at", micros(df, ts)), key, busy_for, tie, run_rows)


def gate(df: DataFrame, key, seconds, tie, run_rows: int) -> DataFrame:
    length = F.col(seconds) if isinstance(seconds, str) else F.lit(float(seconds))
    busy = df.where("_at IS NOT NULL").withColumn("_until", F.col("_at") + F.round(length * 1_000_000).cast("bigint"))
    tie = [tie] if isinstance(tie, str) else list(tie)
    rows = arrange(busy, key, ["_at", *tie], run_rows)
    return accept(rows, "_until").result().drop("_at", "_until")
