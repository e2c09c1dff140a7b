"""Replaying conversations: states, stage durations and timeouts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.numbers import micros
from colloquy.operators.ordered import RUN, RUN_ROWS, arrange

# The states and the limits of a stage in seconds; listening has none.
STATES = ["OFF", "WAITING", "LISTENING", "THINKING", "SPEAKING", "ERROR"]
STAGE_LIMITS = {"THINKING": 30.0, "SPEAKING": 120.0}

EVENTS = ["trigger", "transcript", "short_transcript", "answer", "done", "failure", "enable", "disable"]
_MOVES = {
    "WAITING": {"trigger": "LISTENING"},
    "LISTENING": {"transcript": "THINKING", "short_transcript": "WAITING"},
    "THINKING": {"answer": "SPEAKING"},
    "SPEAKING": {"done": "WAITING"},
}


def next_state(state: str, event: str | None) -> str:
    """One transition. Events a state does not know leave it alone.

    An error lasts until the next event, which finds the conversation waiting.
    """
    if event == "disable":
        return "OFF"
    if state == "OFF":
        return "WAITING" if event == "enable" else "OFF"
    if event == "failure":
        return "ERROR"
    if state == "ERROR" and event not in EVENTS:
        return "ERROR"
    state = "WAITING" if state == "ERROR" else state
    return _MOVES.get(state, {}).get(event, state)


def _table() -> list:
    return [[STATES.index(next_state(s, e)) for e in [*EVENTS, None]] for s in STATES]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _follow(events: pd.Series, start: pd.Series) -> pd.Series:
    """States after each event."""
    moves = _table()

    def one(codes, state):
        out = []
        for code in codes:
            state = moves[state][code]
            out.append(state)
        return out

    return pd.Series([one(*row) for row in zip(events, start)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _effect(events: pd.Series) -> pd.Series:
    """Where a run leads from each of the states."""
    moves = np.array(_table())

    def one(codes):
        at = np.arange(len(STATES))
        for code in codes:
            at = moves[at, code]
        return at

    return pd.Series([one(codes) for codes in events])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _starts(effects: pd.Series, start: pd.Series) -> pd.Series:
    def one(runs, state):
        out = []
        for effect in runs:
            out.append(state)
            state = int(effect[state])
        return out

    return pd.Series([one(*row) for row in zip(effects, start)])


def replay_states(
    events: DataFrame, key: str, ts: str, event: str, mapping: dict | None = None, initial: str = "WAITING",
    tie=(), run_rows: int = RUN_ROWS,
) -> DataFrame:
    """State after each event: the input rows with ``event`` mapped and ``state``.

    A long conversation is replayed run by run: a run is a function from state to
    state, the functions are chained per key, then every run is replayed from its
    known start. Rows without a time are left out.
    """
    named = F.col(event)
    if mapping is not None:
        table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        named = F.try_element_at(table, F.col(event))
    tie = [tie] if isinstance(tie, str) else list(tie)
    code = F.coalesce(
        *[F.when(F.col("_event") == e, F.lit(i)) for i, e in enumerate(EVENTS)], F.lit(len(EVENTS))
    )
    kept = [c for c in events.columns if c not in (key, event)]
    coded = events.withColumn("_at", micros(events, ts)).where("_at IS NOT NULL").withColumn("_event", named).withColumn("_code", code)
    rows = arrange(coded, key, ["_at", *tie], run_rows)
    item = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(rows.order)], "_code")
    whole = F.struct(*kept, F.col("_event").alias("event"))
    # the key as a struct: joins on it keep null keys
    runs = rows.df.groupBy(F.struct(key).alias("_key"), RUN).agg(F.collect_list(item).alias("_rows"), F.collect_list(whole).alias("_all"))
    # whole rows are not compared, so columns of any type will do; both lists are in one order
    runs = runs.withColumn("_rows", F.array_sort(F.transform("_rows", lambda x, i: x.withField("_i", i))))
    first = F.lit(STATES.index(initial))
    if rows.split:
        effects = runs.select("_key", RUN, _effect(F.col("_rows._code")).alias("_e"))
        chained = effects.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(RUN, "_e"))).alias("_runs"))
        chained = chained.withColumn("_start", _starts(F.col("_runs._e"), first))
        entry = chained.select("_key", F.inline(F.arrays_zip(F.col(f"_runs.{RUN}").alias(RUN), F.col("_start").alias("_start"))))
        runs = runs.join(entry, ["_key", RUN])
    else:
        runs = runs.withColumn("_start", first)
    followed = runs.withColumn("_states", _follow(F.col("_rows._code"), F.col("_start")))
    flat = followed.select("_key", F.inline(F.arrays_zip(F.transform("_rows", lambda x: F.get(F.col("_all"), x["_i"])).alias("row"), F.col("_states").alias("no"))))
    names = F.array(*[F.lit(s) for s in STATES])
    return flat.select("_key.*", "row.*", F.get(names, F.col("no")).alias("state"))


def stage_durations(
    state_log: DataFrame, key: str, ts: str, state: str = "state", limits: dict | None = None, tie=(),
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Add the seconds until the next row of a key and whether they exceed the
    state's limit; the last row has no duration. Rows without a time are left out."""
    limits = STAGE_LIMITS if limits is None else limits
    tie = [tie] if isinstance(tie, str) else list(tie)
    rows = arrange(state_log.withColumn("_at", micros(state_log, ts)).where("_at IS NOT NULL"), key, ["_at", *tie], run_rows)
    timed = rows.lead("_at", "_next").result()
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    seconds = (F.col("_next") - F.col("_at")) / 1_000_000
    over = F.coalesce(seconds > F.try_element_at(table, F.col(state)), F.lit(False))
    return timed.withColumn("seconds", seconds).withColumn("timed_out", over).drop("_at", "_next")
