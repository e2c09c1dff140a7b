"""Each stream gives the rows of its batch form, with input cut into several files."""

import pickle
import random
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators import dialogue, gating, signals, utterances
from colloquy.streaming import signals as streams
from colloquy.streaming.stateful import AT, END_MS, OrderedSteps, end_marker


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Rows in four files, late within and across files by less than the delay."""
    folder = str(tmp_path_factory.mktemp("audio"))
    rnd = random.Random(8)
    rows = []
    for key, n in ((1, 120), (2, 40), (3, 2)):
        at = 0.0
        for i in range(n):
            at += rnd.choice([0.5, 1, 2.5])
            kind = rnd.choice(["chunk"] * 4 + ["end", "trigger", "on", "off", "failure", "answer"])
            rows.append((key, i, at, kind, rnd.random(), [float(i)] * rnd.choice([1, 3, 4])))
    rows.sort(key=lambda r: r[2] + rnd.uniform(-2, 2))
    shape = "key int, id int, at double, kind string, p double, samples array<float>"
    step = -(-len(rows) // 4)
    for i in range(4):
        part = spark.createDataFrame(rows[i * step:(i + 1) * step], shape).withColumn("ts", F.timestamp_seconds("at"))
        part.coalesce(1).write.mode("append").parquet(folder)
    end_marker(spark, part.schema, "ts").coalesce(1).write.mode("append").parquet(folder)
    return folder


def batch(spark, source):
    return spark.read.parquet(source).where("kind IS NOT NULL")


def stream(spark, source):
    shape = spark.read.parquet(source).schema
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)


def finish(df, tmp_path):
    name = uuid.uuid4().hex
    out, state = str(tmp_path / name), str(tmp_path / f"{name}-state")
    running = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    running.awaitTermination()
    assert running.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(out)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_debounce_and_gate(spark, source, tmp_path):
    want = gating.debounce(batch(spark, source), "key", "ts", "p", 0.3, 4.0, "id")
    got = finish(streams.debounce_stream(stream(spark, source), "key", "ts", "p", 0.3, 4.0, tie=["id"]), tmp_path)
    assert rows(got, "key", "id") == rows(want, "key", "id") and got.count() > 10
    lasting = lambda df: df.withColumn("busy", F.col("p") * 10)
    want = gating.gate_triggers(lasting(batch(spark, source)), "key", "ts", "busy", "id")
    got = finish(streams.gate_stream(lasting(stream(spark, source)), "key", "ts", "busy", tie=["id"]), tmp_path)
    assert rows(got, "key", "id") == rows(want, "key", "id")


def test_zone_of_the_session_does_not_matter(spark, source, tmp_path):
    want = rows(gating.debounce(batch(spark, source), "key", "ts", "p", 0.5, 9.0, "id"), "key", "id")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = finish(streams.debounce_stream(stream(spark, source), "key", "ts", "p", 0.5, 9.0, tie=["id"]), tmp_path)
        late = got.join(batch(spark, source), ["key", "id", "ts"], "left_anti").count()
        assert rows(got, "key", "id") == want and late == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_reframe(spark, source, tmp_path):
    want = signals.reframe(batch(spark, source), "key", ["ts", "id"], "samples", 5)
    got = finish(streams.reframe_stream(stream(spark, source), "key", "ts", "samples", 5, tie=["id"]), tmp_path)
    assert rows(got, "key", "frame_no", "samples") == rows(want, "key", "frame_no", "samples")


def test_hysteresis(spark, source, tmp_path):
    args = {"t": 0.6, "margin": 0.2, "min_silence": 20, "pad": 3, "frame": 10}
    want = signals.hysteresis_segments(batch(spark, source), "key", ["ts", "id"], "p", **args)
    got = finish(streams.hysteresis_stream(stream(spark, source), "key", "ts", "p", tie=["id"], **args), tmp_path)
    cols = ("key", "segment", "start_pos", "end_pos")
    assert rows(got, *cols) == rows(want, *cols) and got.count() > 3


def test_replay(spark, source, tmp_path):
    roles = {"trigger": "trigger", "chunk": "transcript", "answer": "answer", "end": "done", "failure": "failure",
             "off": "disable", "on": "enable"}
    keep = ["key", "id", "ts", "kind"]
    want = dialogue.replay_states(batch(spark, source).select(*keep), "key", "ts", "kind", roles, tie="id")
    got = finish(streams.replay_stream(stream(spark, source).select(*keep), "key", "ts", "kind", roles, tie=["id"]), tmp_path)
    assert rows(got, "key", "id", "event", "state") == rows(want, "key", "id", "event", "state")


def test_switch(spark, source, tmp_path):
    def sides(df):
        turns = df.where("kind IN ('on', 'off')").withColumn("enabled", F.col("kind") == "on").select("key", "ts", "enabled")
        return df.where("kind IS NULL OR kind NOT IN ('on', 'off')").select("key", "ts", "id"), turns

    want = signals.while_enabled(*sides(batch(spark, source)), "key", "ts")
    got = finish(streams.while_enabled_stream(*sides(stream(spark, source)), "key", "ts"), tmp_path)
    assert rows(got, "key", "id") == rows(want, "key", "id") and got.count() > 5


def test_utterances(spark, source, tmp_path):
    def sides(df):
        return (df.where("kind IS NULL OR kind NOT IN ('trigger', 'on')").select("key", "ts", "samples"),
                df.where("kind = 'trigger'").select("key", "ts"), df.where("kind = 'end'").select("key", "ts"))

    audio, triggers, ends = sides(batch(spark, source))
    captures = utterances.trigger_captures(audio, triggers, ends, "key", timeout=6.0)
    want = utterances.assemble_utterances(audio, captures, "key", rate=9, chunk=4)
    got = finish(streams.utterance_stream(*sides(stream(spark, source)), "key", timeout=6.0, rate=9, chunk=4), tmp_path)
    cols = ("key", "utt_no", "samples", "ended_by")
    assert rows(got, *cols) == rows(want, *cols) and got.count() > 3


def test_large_ids_and_nulls(spark, tmp_path):
    shape = "key int, id bigint, sec int, on_off boolean, p double, busy double, samples array<float>"
    big = 2**60
    data = [(1, big + 3, 1, None, None, None, None), (1, None, 2, True, 0.9, 1.0, [1.0, 2.0]), (1, big + 5, 3, None, 0.9, None, [3.0]),
            (1, big + 7, 4, None, None, 1.0, None), (1, big + 9, 5, None, 0.1, 1.0, [4.0])]
    df = spark.createDataFrame(data, shape).withColumn("ts", F.timestamp_seconds("sec"))
    folder = str(tmp_path / "in")
    df.coalesce(1).write.parquet(folder)
    end_marker(spark, df.schema, "ts").coalesce(1).write.mode("append").parquet(folder)

    def sides(d):
        return d.where("on_off IS NULL").select("key", "id", "ts"), d.where("on_off IS NOT NULL").select("key", "ts", F.col("on_off").alias("enabled"))

    want = signals.while_enabled(*sides(df), "key", "ts", True)
    got = finish(streams.while_enabled_stream(*sides(stream(spark, folder)), "key", "ts", True), tmp_path)
    assert rows(got, "key", "id") == rows(want, "key", "id") == [(1, big + i) for i in (3, 5, 7, 9)]
    args = {"t": 0.5, "margin": 0.1, "min_silence": 0, "pad": 0, "frame": 1}
    want = signals.hysteresis_segments(df, "key", ["ts"], "p", **args)
    got = finish(streams.hysteresis_stream(stream(spark, folder), "key", "ts", "p", **args), tmp_path)
    assert rows(got, "segment", "start_pos", "end_pos") == rows(want, "segment", "start_pos", "end_pos")
    want = gating.gate_triggers(df, "key", "ts", "busy")
    got = finish(streams.gate_stream(stream(spark, folder), "key", "ts", "busy"), tmp_path)
    assert rows(got, "key", "id") == rows(want, "key", "id")
    want = signals.reframe(df, "key", ["ts"], "samples", 2)
    got = finish(streams.reframe_stream(stream(spark, folder), "key", "ts", "samples", 2), tmp_path)
    assert rows(got, "frame_no", "samples") == rows(want, "frame_no", "samples")


def test_resets(spark, source, tmp_path):
    """A reset starts the detector and the frames anew, in both forms alike."""
    args = {"t": 0.6, "margin": 0.2, "min_silence": 20, "pad": 3, "frame": 10}
    kept = lambda df: df.where("kind IS NULL OR kind NOT IN ('chunk')").withColumn("again", F.col("kind") == "trigger")
    every = kept(batch(spark, source))
    frames = signals.with_epoch(every.where("not again"), every.where("again"), "key", "ts")
    want = signals.hysteresis_segments(frames, ["key", "epoch"], ["ts", "id"], "p", **args)
    got = finish(streams.hysteresis_stream(kept(stream(spark, source)), "key", "ts", "p", tie=["id"], reset="again", **args), tmp_path)
    cols = ("key", "epoch", "segment", "start_pos", "end_pos")
    assert rows(got, *cols) == rows(want, *cols) and got.where("epoch > 1").count() > 3
    want = signals.reframe(frames, ["key", "epoch"], ["ts", "id"], "samples", 5)
    got = finish(streams.reframe_stream(kept(stream(spark, source)), "key", "ts", "samples", 5, tie=["id"], reset="again"), tmp_path)
    assert rows(got, "key", "epoch", "frame_no", "samples") == rows(want, "key", "epoch", "frame_no", "samples")


def test_timer_ends_a_capture(spark, source, tmp_path):
    """Captures end by the clock: batch and stream alike, and many of them have no later chunk in time."""
    def sides(df):
        return (df.where("kind IS NULL OR kind NOT IN ('trigger', 'on')").select("key", "ts", "samples"),
                df.where("kind = 'trigger'").select("key", "ts"), df.where("kind = 'end'").select("key", "ts"))

    audio, triggers, ends = sides(batch(spark, source))
    for timeout in (0.4, 6.0):
        captures = utterances.trigger_captures(audio, triggers, ends, "key", timeout=timeout, timer=True)
        want = utterances.assemble_utterances(audio, captures, "key", rate=9, chunk=4)
        got = finish(streams.utterance_stream(*sides(stream(spark, source)), "key", timeout=timeout, rate=9, chunk=4, timer=True, bucket_ms=700), tmp_path)
        cols = ("key", "utt_no", "samples", "ended_by")
        assert rows(got, *cols) == rows(want, *cols) and got.where("ended_by = 'timeout'").count() > 0


def test_capture_without_further_audio_is_flushed_by_the_watermark(spark, tmp_path):
    """No chunk of the key comes after the trigger and no marker ends the stream; another key moves the time."""
    folder = str(tmp_path / "in")
    shape = "key int, at int, kind string, samples array<float>"
    for i, part in enumerate([[(1, 1, "audio", [1.0, 2.0]), (1, 2, "trigger", None), (2, 3, "audio", [9.0])], [(2, 40, "audio", [9.0])], [(2, 80, "audio", [9.0])]]):
        spark.createDataFrame(part, shape).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(folder)

    def sides(df):
        return tuple(df.where(f"kind = '{k}'").select("key", "ts", *c) for k, c in (("audio", ["samples"]), ("trigger", []), ("end", [])))

    for timer, want in ((True, [(1, 1, [1.0, 2.0], "timeout")]), (False, [])):
        got = finish(streams.utterance_stream(*sides(stream(spark, folder)), "key", timeout=6.0, rate=0, delay="0 seconds", timer=timer, bucket_ms=1000), tmp_path)
        assert rows(got, "key", "utt_no", "samples", "ended_by") == want


def test_speech_starts_in_a_stream(spark, source, tmp_path):
    args = {"t": 0.6, "margin": 0.2, "min_silence": 20, "pad": 13, "frame": 10}
    frames = batch(spark, source)
    found = signals.hysteresis_segments(frames, "key", ["ts", "id"], "p", **args)
    timed = found.withColumns({c: F.timestamp_micros(c) for c in ("start_pos", "end_pos")})
    captures = utterances.speech_captures(timed, "key", "start_pos", "end_pos")
    place = F.row_number().over(Window.partitionBy("key").orderBy("ts", "id")) * 10
    audio = frames.select("key", F.timestamp_micros(place.cast("bigint")).alias("ts"), "samples")
    want = utterances.assemble_utterances(audio, captures, "key", rate=9, chunk=4)
    got = finish(streams.speech_utterance_stream(stream(spark, source), "key", "ts", "p", rate=9, chunk=4, tie=["id"], bucket_ms=500, **args), tmp_path)
    cols = ("key", "utt_no", "samples", "ended_by")
    assert rows(got, *cols) == rows(want, *cols) and got.count() > 3
    with pytest.raises(ValueError):
        streams.speech_utterance_stream(frames, "key", "ts", "p", pad=100, frame=10, min_silence=50)


def test_stages_are_reported_at_their_deadline(spark, source, tmp_path):
    limits = {"trigger": 1.0, "chunk": 2.0, "end": 0.5}
    keep = ["key", "id", "ts", "kind"]
    want = dialogue.stage_durations(batch(spark, source).select(*keep), "key", "ts", "kind", limits, "id")
    got = finish(streams.stage_stream(stream(spark, source).select(*keep), "key", "ts", "kind", limits, tie=["id"], bucket_ms=300), tmp_path)
    cols = ("key", "id", "kind", "seconds", "timed_out")
    assert rows(got.where("not open"), *cols) == rows(want, *cols)
    late = {(r.key, r.id) for r in want.collect() if r.timed_out or (r.seconds is None and r.kind in limits)}
    reports = got.where("open").collect()
    assert {(r.key, r.id) for r in reports} == late and len(reports) == len(late) > 3
    assert all(r.timed_out and r.seconds == limits[r.kind] for r in reports)


def test_an_open_stage_is_reported_before_its_next_state(spark, tmp_path):
    """The report comes with the watermark; the stage itself has not ended yet."""
    folder = str(tmp_path / "in")
    for part in ([(1, 1, "THINKING")], [(2, 33, "WAITING")], [(2, 60, "WAITING")]):
        spark.createDataFrame(part, "key int, at int, state string").withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(folder)
    log = stream(spark, folder).select("key", "ts", "state")
    got = finish(streams.stage_stream(log, "key", "ts", delay="0 seconds", bucket_ms=1000), tmp_path)
    assert rows(got, "key", "state", "seconds", "timed_out", "open") == [(1, "THINKING", 30.0, True, True)]


class Memory:
    """The state of one key in memory, with the rows that were moved counted."""

    def __init__(self):
        self.timers, self.moved = set(), 0

    def getMapState(self, name, *_):
        outer, kept = self, {}

        class Map:
            def containsKey(self, key):
                return key in kept

            def getValue(self, key):
                outer.moved += name == "pieces" and len(pickle.loads(kept[key][0]))
                return kept[key]

            def updateValue(self, key, value):
                outer.moved += name == "pieces" and len(pickle.loads(value[0]))
                kept[key] = value

            def removeKey(self, key):
                del kept[key]

        return Map()

    def getValueState(self, *_):
        class Value:
            now = None

            def get(self):
                return self.now

            def update(self, value):
                self.now = value

        return Value()

    def registerTimer(self, at):
        self.timers.add(at)


def test_a_hot_key_costs_work_in_proportion_to_its_rows():
    """A million rows of one key in a hundred micro-batches: each is written and read once."""
    shape = T.StructType([T.StructField("v", T.LongType()), T.StructField(AT, T.LongType())])

    class Expired:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

    def step(state, rows):
        return ((state[0] if state else 0) + sum(r["v"] for r in rows),), []

    steps, memory, n = OrderedSteps(shape, ["key"], None, T.StructType([]), step, [], None, None, None, 10_000), Memory(), 1_000_000
    steps.init(memory)
    calls = 0
    for batch_no in range(100):
        fresh = range(batch_no * n // 100, (batch_no + 1) * n // 100)
        list(steps.handleInputRows((1,), ({"v": i, AT: 1000 * i - (i % 7) * 1000} for i in fresh), None))
        for at in sorted(t for t in memory.timers if t <= fresh[-1] - 10_000):
            memory.timers.remove(at)
            calls += 1
            list(steps.handleExpiredTimer((1,), None, Expired(at)))
    for at in sorted(memory.timers):
        list(steps.handleExpiredTimer((1,), None, Expired(at)))
    assert memory.moved == 2 * n and steps.state.get() == (n * (n - 1) // 2,) and calls <= n // 10_000 + 2


def test_rows_of_many_buckets_cost_one_value_and_one_timer():
    """A key with few rows in a bucket each: they wait in one value and leave together, in order, closed at the end."""
    shape = T.StructType([T.StructField("v", T.LongType()), T.StructField(AT, T.LongType())])
    out = T.StructType([T.StructField("v", T.LongType())])

    class Now:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

        getCurrentWatermarkInMs = getExpiryTimeInMs

    def step(state, rows):
        return (len(rows) + (state[0] if state else 0),), rows

    steps, memory = OrderedSteps(shape, ["key"], None, out, step, [], lambda state: [{"v": -state[0]}], None, None, 10_000), Memory()
    steps.init(memory)
    moments = [(i * 37 % 60) * 10_000 for i in range(60)]
    list(steps.handleInputRows((1,), ({"v": at, AT: at * 1000} for at in moments), None))
    assert memory.timers == {10_000}
    found = []
    for now in (205_000, 400_000, END_MS + 5):
        for at in sorted(t for t in memory.timers if t <= now):
            memory.timers.remove(at)
            found += [r.v for r in steps.handleExpiredTimer((1,), Now(now), Now(at))]
        if now == 205_000:
            assert found == list(range(0, 200_000, 10_000))
    assert found == [*range(0, 600_000, 10_000), -60] and memory.moved == 0
