"""Ordered operators against plain loops, short and long keys alike."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import dialogue, gating, labelled, quantiles, signals, utterances
from colloquy.operators.documents import assign_batches, ingest_report
from colloquy.operators.prompts import request_stats

RUNS = [200_000, 19]


@pytest.fixture(scope="module")
def frames(spark):
    rnd = random.Random(11)
    rows = []
    for key, n in ((1, 400), (2, 60), (3, 1)):
        p = 0.2
        for i in range(n):
            p = min(1.0, max(0.0, p + rnd.uniform(-0.3, 0.3)))
            rows.append((key, i, round(p, 2), [float(rnd.randrange(100)) for _ in range(rnd.choice([0, 1, 3, 7, 12]))]))
    return spark.createDataFrame(rows, "key int, no int, p double, samples array<float>").repartition(4)


def segments_by_hand(probs, t, margin, silence, pad, frame):
    at, out, speaking, pending = 0, [], None, None
    for p in probs:
        at += frame
        if p >= t:
            pending = None
            if speaking is None:
                speaking = at - pad - frame
        elif p < t - margin and speaking is not None:
            pending = at if pending is None else pending
            if at - pending >= silence:
                out.append((speaking, pending + pad - frame))
                speaking = pending = None
    if speaking is not None:
        out.append((speaking, None))
    return out


@pytest.mark.parametrize("run_rows", RUNS)
@pytest.mark.parametrize("silence", [0, 20, 55])
def test_hysteresis(frames, run_rows, silence):
    got = signals.hysteresis_segments(
        frames, "key", "no", "p", t=0.5, margin=0.15, min_silence=silence, pad=4, frame=10, run_rows=run_rows
    )
    by_key = {}
    for r in frames.orderBy("key", "no").collect():
        by_key.setdefault(r.key, []).append(r.p)
    want = [
        (k, n + 1, s, e) for k, ps in by_key.items() for n, (s, e) in enumerate(segments_by_hand(ps, 0.5, 0.15, silence, 4, 10))
    ]
    assert sorted((r.key, r.segment, r.start_pos, r.end_pos) for r in got.collect()) == sorted(want)


def test_pending_end_survives_the_band_between(spark):
    # 0.4 lies between t - 0.15 and t: it neither clears nor confirms the end
    rows = [(1, i, p) for i, p in enumerate([0.9, 0.1, 0.4, 0.4, 0.1, 0.9])]
    df = spark.createDataFrame(rows, "key int, no int, p double")
    got = signals.hysteresis_segments(df, "key", "no", "p", min_silence=30, pad=0, frame=10).orderBy("segment").collect()
    assert [(r.start_pos, r.end_pos) for r in got] == [(0, 10), (50, None)]
    early = signals.hysteresis_segments(df, "key", "no", "p", min_silence=30, pad=5, frame=10, clip=True)
    assert min(r.start_pos for r in early.collect()) == 0


@pytest.mark.parametrize("run_rows", RUNS)
def test_reframe(frames, run_rows):
    got = {(r.key, r.frame_no): r.samples for r in signals.reframe(frames, "key", "no", "samples", 8, run_rows).collect()}
    want = {}
    by_key = {}
    for r in frames.orderBy("key", "no").collect():
        by_key.setdefault(r.key, []).extend(r.samples)
    for k, xs in by_key.items():
        for i in range(len(xs) // 8):
            want[(k, i)] = xs[8 * i: 8 * i + 8]
    assert got == want


@pytest.mark.parametrize("run_rows", RUNS)
def test_preroll(frames, run_rows):
    got = {(r.key, r.no): r.with_preroll for r in signals.with_preroll(frames, "key", "no", run_rows=run_rows).collect()}
    rows = {(r.key, r.no): r.samples for r in frames.collect()}
    assert got == {(k, n): rows.get((k, n - 1), []) + s for (k, n), s in rows.items()}


@pytest.mark.parametrize("run_rows", RUNS)
@pytest.mark.parametrize("initial", [True, False])
def test_switch(spark, frames, run_rows, initial):
    turns = spark.createDataFrame([(1, 50, True), (1, 200, False), (1, 201, True), (2, 0, False), (2, 10, True)],
                                  "key int, no int, enabled boolean")
    got = signals.while_enabled(frames.select("key", "no"), turns, "key", "no", initial, run_rows=run_rows)
    on = lambda k, n: {1: initial if n < 50 else n != 200, 2: n >= 10, 3: initial}[k]
    assert sorted(map(tuple, got.collect())) == sorted((r.key, r.no) for r in frames.collect() if on(r.key, r.no))


@pytest.fixture(scope="module")
def talk(spark):
    rnd = random.Random(5)
    rows = []
    for key, n in ((1, 300), (2, 50), (3, 4)):
        at = 0
        for i in range(n):
            at += rnd.randrange(1, 4)
            kind = rnd.choice(["chunk"] * 6 + ["end"] * 2 + ["trigger"] * 3)
            rows.append((key, at * 1_000_000, kind, [float(i), float(i) / 2]))
    return spark.createDataFrame(rows, "key int, ts bigint, kind string, samples array<float>").repartition(3)


def split_talk(talk):
    return (
        talk.where("kind <> 'trigger'").select("key", "ts", "samples"), talk.where("kind = 'trigger'").select("key", "ts"),
        talk.where("kind = 'end'").select("key", "ts"),
    )


def utterances_by_hand(rows, timeout, rate, chunk):
    """The capture loop, message by message; an 'end' chunk is one in which speech ends."""
    out, front, held, begun, no = [], [], [], None, 0
    for ts, kind, samples in rows:
        if kind == "trigger":
            if begun is None:
                begun, held = ts, list(front)
            continue
        front = samples
        if begun is None:
            continue
        held = held + samples
        if kind == "end" or ts - begun >= timeout * 1_000_000:
            no += 1
            if len(held) < rate:
                held = held + [0.0] * (chunk + rate - len(held))
            out.append((no, held, "speech_end" if kind == "end" else "timeout"))
            begun = None
    return out


@pytest.mark.parametrize("run_rows", RUNS)
@pytest.mark.parametrize("timeout", [5, 12])
def test_utterances(talk, run_rows, timeout):
    audio, triggers, ends = split_talk(talk)
    captures = utterances.trigger_captures(audio, triggers, ends, "key", timeout=timeout, run_rows=run_rows)
    got = utterances.assemble_utterances(audio, captures, "key", rate=7, chunk=2, run_rows=run_rows)
    by_key = {}
    for r in talk.orderBy("key", "ts").collect():
        by_key.setdefault(r.key, []).append((r.ts, r.kind, r.samples))
    want = [(k, *u) for k, rows in by_key.items() for u in utterances_by_hand(rows, timeout, 7, 2)]
    assert sorted((r.key, r.utt_no, r.samples, r.ended_by) for r in got.collect()) == sorted(want)
    assert {w[3] for w in want} == {"speech_end", "timeout"}


def test_utterances_from_speech(spark):
    audio = spark.createDataFrame([(1, t, [float(t)]) for t in range(10)], "key int, ts bigint, samples array<float>")
    speech = spark.createDataFrame([(1, 2, 4), (1, 7, 8), (1, 9, None)], "key int, s bigint, e bigint")
    captures = utterances.speech_captures(speech, "key", "s", "e")
    got = utterances.assemble_utterances(audio, captures, "key", rate=1, chunk=1)
    assert {r.utt_no: r.samples for r in got.collect()} == {1: [1.0, 2.0, 3.0, 4.0], 2: [6.0, 7.0, 8.0]}


@pytest.mark.parametrize("run_rows", RUNS)
def test_replay(spark, run_rows):
    rnd = random.Random(4)
    rows = [(k, i, rnd.choice([*dialogue.EVENTS, "noise"])) for k, n in ((1, 300), (2, 30), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "key int, ts bigint, event string").repartition(3)
    got = dialogue.replay_states(df, "key", "ts", "event", run_rows=run_rows)
    want, state = [], {}
    for k, i, e in rows:
        state[k] = dialogue.next_state(state.get(k, "WAITING"), e)
        want.append((k, i, e, state[k]))
    assert sorted(((r.key, r.ts, r.event, r.state) for r in got.collect()), key=str) == sorted(want, key=str)


def test_transitions():
    path, state = [], "WAITING"
    for e in ["trigger", "trigger", "short_transcript", "trigger", "transcript", "answer", "done", "failure", "trigger",
              "disable", "trigger", "failure", "enable", "enable"]:
        state = dialogue.next_state(state, e)
        path.append(state)
    assert path == ["LISTENING", "LISTENING", "WAITING", "LISTENING", "THINKING", "SPEAKING", "WAITING", "ERROR", "LISTENING",
                    "OFF", "OFF", "OFF", "WAITING", "WAITING"]
    assert dialogue.next_state("ERROR", "noise") == "ERROR"


def test_stage_limits(spark):
    log = spark.createDataFrame(
        [(1, 0, "THINKING"), (1, 30_000_000, "SPEAKING"), (1, 150_000_001, "LISTENING"), (1, 10**12, "WAITING")],
        "key int, ts bigint, state string",
    )
    got = [(r.seconds, r.timed_out) for r in dialogue.stage_durations(log, "key", "ts").orderBy("ts").collect()]
    assert got[0] == (30.0, False) and got[1] == (120.000001, True) and got[2][1] is False and got[3] == (None, False)


@pytest.mark.parametrize("run_rows", RUNS)
def test_batches_and_percentiles(spark, frames, run_rows):
    numbered = assign_batches(frames.select("key", "no"), ["key", "no"], 7, run_rows)
    rows = numbered.orderBy("key", "no").collect()
    assert [r.batch_num for r in rows] == [i // 7 + 1 for i in range(461)] and rows[0].total_batches == 66
    got = {r.key: r.p for r in quantiles.exact_percentiles(frames, "key", "p", {"p": 0.9}, run_rows).collect()}
    want = {r.key: r.p for r in frames.groupBy("key").agg(F.percentile("p", F.lit(0.9)).alias("p")).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("run_rows", RUNS)
def test_threshold(frames, run_rows):
    scored = frames.select(F.col("p").alias("score"), (F.col("no") % 3 == 0).alias("negative"))
    got = quantiles.calibrate_threshold(scored, 10.0, 2.0, run_rows=run_rows).first()
    rows = scored.collect()
    bad = lambda t: sum(r.negative for r in rows if r.score >= t)
    want = min(t for t in {r.score for r in rows} if bad(t) <= 20)
    assert (got.threshold, got.false_positives) == (want, bad(want))


def test_request_stats(spark):
    log = spark.createDataFrame([("a", True, 1.0), ("a", False, 3.0), ("b", False, 2.0)], "route string, succeeded boolean, seconds double")
    got = {r.route: (r.n, r.n_failed, r["mean"], r.p50) for r in request_stats(log).collect()}
    assert got == {"a": (2, 1, 2.0, 2.0), "b": (1, 1, 2.0, 2.0)}


def test_latest_and_report(spark, frames):
    got = {r.key: r.p for r in signals.latest_score(frames, "key", "no", "p").collect()}
    rows = {(r.key, r.no): r.p for r in frames.collect()}
    assert got == {k: rows[(k, n - 1)] for k, n in ((1, 400), (2, 60), (3, 1))}
    assert ingest_report(frames, frames.where("key = 2")).first()[:2] == (461, 60)


@pytest.mark.parametrize("run_rows", RUNS)
def test_labelled_rows(frames, run_rows):
    ids = frames.select("key", (F.col("key") * 1000 + F.col("no")).alias("id"))
    split = labelled.sample_splits(ids, "key", {1: {"train": 100, "test": 50}, 2: {"train": 50, "test": 30}}, "id", 3, run_rows)
    sizes = {(r.key, r.split): r["count"] for r in split.groupBy("key", "split").count().collect()}
    assert sizes == {(1, "train"): 100, (1, "test"): 50, (2, "train"): 50, (2, "test"): 10}
    mixed = labelled.compose_batches(ids, "key", {1: 30, 2: 5}, "id", 3, run_rows)
    shape = {(r.batch_no, r.key): r["count"] for r in mixed.groupBy("batch_no", "key").count().collect()}
    assert shape == {(b, k): n for b in range(12) for k, n in ((1, 30), (2, 5))}


def test_phrases(spark):
    df = spark.createDataFrame([(" Hey Robot ",), ("ROBOTER",), ("tea",)], "t string")
    assert [r.label for r in labelled.label_phrases(df, "t").collect()] == ["positive", "adversarial", "background"]


def test_rows_without_a_time_take_no_part(spark):
    """They hold up no key, in one run and in runs of two."""
    shape = "key int, sec int, score double, kind string"
    data = [(1, 10 * i, 0.9, "trigger") for i in range(5)] + [(1, None, 0.9, "trigger"), (1, None, 0.9, "failure")]
    df = spark.createDataFrame(data, shape).withColumn("ts", F.timestamp_seconds("sec"))
    for run_rows in (2, 100):
        kept = gating.debounce(df, "key", "ts", "score", 0.5, 5.0, run_rows=run_rows)
        assert sorted(r.sec for r in kept.collect()) == [0, 10, 20, 30, 40]
        kept = gating.gate_triggers(df, "key", "ts", 15.0, run_rows=run_rows)
        assert sorted(r.sec for r in kept.collect()) == [0, 20, 40]
        log = dialogue.replay_states(df.drop("score"), "key", "ts", "kind", run_rows=run_rows)
        assert {r.state for r in log.collect()} == {"LISTENING"} and log.count() == 5
        timed = dialogue.stage_durations(df, "key", "ts", "kind", {"trigger": 5.0}, run_rows=run_rows)
        assert sorted((r.sec, r.timed_out) for r in timed.collect()) == [(i, i < 40) for i in range(0, 50, 10)]
        audio = df.select("key", "ts", F.array(F.col("score").cast("float")).alias("samples"))
        none = audio.where("false").select("key", "ts")
        captures = utterances.trigger_captures(audio, df.select("key", "ts"), none, "key", timeout=10.0, run_rows=run_rows)
        assert sorted(r.start_us // 1_000_000 for r in captures.collect()) == [0, 20]
