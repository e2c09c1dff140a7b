"""Runs and plain windows must agree, whatever the length of a key."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators.gating import debounce, gate_triggers
from colloquy.operators.ordered import arrange


@pytest.fixture(scope="module")
def ticks(spark):
    rnd = random.Random(7)
    rows = []
    for key, n in ((1, 700), (2, 40), (3, 1), (None, 90)):
        at = 0
        for i in range(n):
            at += rnd.choice([0, 1, 1, 2, 5, 30])
            rows.append((key, i, at, rnd.random() if rnd.random() < 0.6 else None, rnd.randrange(1, 20)))
    return spark.createDataFrame(rows, "key int, id int, at bigint, v double, busy int").repartition(5)


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("step", [
    lambda o: o.running_sum("busy", "out"),
    lambda o: o.last_value("v", "out"),
    lambda o: o.last_value("v", "out", current=False),
    lambda o: o.next_value("v", "out"),
    lambda o: o.lag("v", "out"),
    lambda o: o.lead("v", "out"),
])
def test_runs_equal_windows(ticks, step):
    plain = step(arrange(ticks, "key", ["at", "id"]))
    cut = step(arrange(ticks, "key", ["at", "id"], run_rows=17))
    assert not plain.split and cut.split
    assert as_set(plain.result()) == as_set(cut.result())


def test_empty_key_is_one_order(ticks):
    cut = arrange(ticks, [], ["key", "at", "id"], run_rows=50).running_sum(F.lit(1), "no")
    assert sorted(r.no for r in cut.result().collect()) == list(range(1, 832))


def str_key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def brute(rows, gap):
    out, busy = [], {}
    for key, at, i, length in sorted(rows, key=str_key):
        if at >= busy.get(key, -1):
            out.append((key, i))
            busy[key] = at + (gap if gap is not None else length * 1_000_000)
    return sorted(out, key=str)


@pytest.mark.parametrize("gap", [0, 3, 7, 50, 400])
@pytest.mark.parametrize("run_rows", [200_000, 23])
def test_debounce(ticks, gap, run_rows):
    got = debounce(ticks, "key", "at", "busy", 5, gap / 1e6, "id", run_rows).select("key", "id")
    rows = [(r.key, r.at, r.id, 0) for r in ticks.collect() if r.busy >= 5]
    assert as_set(got) == brute(rows, gap)


@pytest.mark.parametrize("run_rows", [200_000, 23])
def test_gate_with_own_length(ticks, run_rows):
    df = ticks.withColumn("at", F.col("at") * 1_000_000)
    got = gate_triggers(df, "key", "at", "busy", "id", run_rows).select("key", "id")
    rows = [(r.key, r.at, r.id, r.busy) for r in df.collect()]
    assert as_set(got) == brute(rows, None)
