"""Stream forms of the ordered operators. Each gives the rows of its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.numbers import AUDIO_CHUNK, SAMPLE_RATE
from colloquy.operators.dialogue import EVENTS, STAGE_LIMITS, next_state
from colloquy.operators.signals import FRAME, MARGIN, MIN_SILENCE, SPEECH, SPEECH_PAD
from colloquy.operators.utterances import CAPTURE_TIMEOUT
from colloquy.streaming.stateful import AT, BUCKET_MS, event_time, in_order

NEVER = 2**63 - 1


def _columns(df: DataFrame, key: str) -> list:
    return [(f.name, f.dataType.simpleString()) for f in df.schema if f.name != key]


def debounce_stream(
    df: DataFrame, key: str, ts: str, score: str, threshold: float, gap: float, delay: str = "10 seconds", tie=(),
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Stream form of ``debounce``.

    Scores below the threshold are dropped before the state but still move the
    watermark: the comparison names the event time, which keeps it above it.
    """
    timed = event_time(df, ts, delay)
    over = timed.where(F.when(F.col(ts).isNotNull(), F.col(score)) >= threshold)
    return gate_stream(over, key, ts, gap, None, tie, bucket_ms)


def gate_stream(
    df: DataFrame, key: str, ts: str, busy_for, delay: str | None = "10 seconds", tie=(), bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """Stream form of ``gate_triggers``; ``delay=None`` if ``df`` has a watermark."""
    def step(state, rows):
        until, out = (state[0] if state else None), []
        for row in rows:
            if until is None or row[AT] >= until:
                length = row[busy_for] if isinstance(busy_for, str) else busy_for
                # no length: busy for good
                until = NEVER if length is None else row[AT] + round(length * 1_000_000)
                out.append(row)
        return (until,), out

    return in_order(df, key, ts, "until bigint", _timed(df, key, ts), step, delay, tie, bucket_ms=bucket_ms)


def _timed(df: DataFrame, key: str, ts: str) -> list:
    return [(n, "timestamp" if n == ts else t) for n, t in _columns(df, key)]


def reframe_stream(
    df: DataFrame, key: str, ts: str, col: str = "samples", frame: int = FRAME, delay: str = "10 seconds", tie=(),
    reset: str | None = None, bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Stream form of ``reframe``; the state is the remainder.

    Rows with a true ``reset`` hold no samples: the remainder is dropped and frames
    count anew, as with the key (key, epoch) of ``with_epoch``.
    """
    def step(state, rows):
        left, no, epoch = (list(state[0]), state[1], state[2]) if state else ([], 0, 0)
        out = []
        for row in rows:
            if reset and row[reset]:
                left, no, epoch = [], 0, epoch + 1
                continue
            left.extend(row[col] or [])
            while len(left) >= frame:
                out.append({"frame_no": no, col: left[:frame], "epoch": epoch})
                left, no = left[frame:], no + 1
        return (left, no, epoch), out

    kind = df.schema[col].dataType.simpleString()
    columns = [("frame_no", "bigint"), (col, kind)] + [("epoch", "bigint")] * bool(reset)
    return in_order(df, key, ts, f"left {kind}, no bigint, epoch bigint", columns, step, delay, tie, bucket_ms=bucket_ms)


def _detector(t: float, margin: float, min_silence: int, pad: int, frame: int):
    """A function from (position, segment, start, pending end) and a frame's probability to the same and an ended segment."""
    def hear(heard, p):
        at, no, start, pending = heard
        at, ended = at + frame, None
        if p is not None and p >= t:
            pending = None
            if start is None:
                start, no = at - pad - frame, no + 1
        elif p is not None and p < t - margin and start is not None:
            pending = at if pending is None else pending
            if at - pending >= min_silence:
                ended = (no, start, pending + pad - frame)
                start = pending = None
        return (at, no, start, pending), ended

    return hear


def hysteresis_stream(
    df: DataFrame, key: str, ts: str, prob: str, t: float = SPEECH, margin: float = MARGIN,
    min_silence: int = MIN_SILENCE, pad: int = SPEECH_PAD, frame: int = FRAME, delay: str = "10 seconds", tie=(),
    reset: str | None = None, bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Stream form of ``hysteresis_segments``; a segment is emitted when it ends, an open one at an end marker.

    Rows with a true ``reset`` hold no frame: the detector starts anew after them, as
    with the key (key, epoch) of ``with_epoch``; ``epoch`` is added to the output.
    """
    hear = _detector(t, margin, min_silence, pad, frame)

    def step(state, rows):
        *heard, epoch = state if state else (0, 0, None, None, 0)
        out = []
        for row in rows:
            if reset and row[reset]:
                if heard[2] is not None:
                    out.append({"segment": heard[1], "start_pos": heard[2], "end_pos": None, "epoch": epoch})
                heard, epoch = (0, 0, None, None), epoch + 1
                continue
            heard, ended = hear(heard, row[prob])
            if ended:
                out.append({"segment": ended[0], "start_pos": ended[1], "end_pos": ended[2], "epoch": epoch})
        return (*heard, epoch), out

    def close(state):
        _, no, start, _, epoch = state
        return [] if start is None else [{"segment": no, "start_pos": start, "end_pos": None, "epoch": epoch}]

    columns = [("segment", "bigint"), ("start_pos", "bigint"), ("end_pos", "bigint")] + [("epoch", "bigint")] * bool(reset)
    kept = "at bigint, no bigint, start bigint, pending bigint, epoch bigint"
    return in_order(df, key, ts, kept, columns, step, delay, tie, close, bucket_ms=bucket_ms)


def replay_stream(
    df: DataFrame, key: str, ts: str, event: str, mapping: dict | None = None, initial: str = "WAITING",
    delay: str = "10 seconds", tie=(), bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Stream form of ``replay_states``."""
    def step(state, rows):
        now, out = (state[0] if state else initial), []
        for row in rows:
            name = row[event] if mapping is None else mapping.get(row[event])
            now = next_state(now, name if name in EVENTS else None)
            out.append({**{k: v for k, v in row.items() if k != event}, "event": name, "state": now})
        return (now,), out

    columns = [c for c in _timed(df, key, ts) if c[0] != event] + [("event", "string"), ("state", "string")]
    return in_order(df, key, ts, "state string", columns, step, delay, tie, bucket_ms=bucket_ms)


def while_enabled_stream(
    rows: DataFrame, switches: DataFrame, key: str, ts: str, initial: bool = False, enabled: str = "enabled",
    delay: str = "10 seconds", bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Stream form of ``while_enabled``: two streams merged into one keyed state."""
    merged = rows.withColumn("row_kind", F.lit(1)).unionByName(
        switches.select(key, ts, F.col(enabled).alias("switched_on"), F.lit(0).alias("row_kind")), allowMissingColumns=True
    )
    def step(state, items):
        on, out = (state[0] if state else initial), []
        for row in items:
            if row["row_kind"] == 0:
                on = row["switched_on"] if row["switched_on"] is not None else on
            elif on:
                out.append(row)
        return (on,), out

    return in_order(merged, key, ts, "on boolean", _timed(rows, key, ts), step, delay, ["row_kind"], bucket_ms=bucket_ms)


def utterance_stream(
    audio: DataFrame, triggers: DataFrame, speech_ends: DataFrame, key: str, ts: str = "ts", col: str = "samples",
    timeout: float = CAPTURE_TIMEOUT, rate: int = SAMPLE_RATE, chunk: int = AUDIO_CHUNK, delay: str = "10 seconds",
    timer: bool = False, bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Stream form of trigger capture and assembly: three streams in one keyed state.

    At one moment a trigger comes first, then a speech end, then the chunk. Time runs out on a chunk; with ``timer``
    it runs out by itself, so a capture that gets no more audio is given out at its trigger plus ``timeout`` by the
    watermark alone, and a later chunk is no part of it (as ``trigger_captures`` with ``timer``).
    """
    def side(df, kind):
        return df.select(key, ts, F.lit(kind).alias("row_kind"))

    merged = (
        audio.select(key, ts, col, F.lit(2).alias("row_kind"))
        .unionByName(side(triggers, 0), allowMissingColumns=True)
        .unionByName(side(speech_ends, 1), allowMissingColumns=True)
    )
    limit = round(timeout * 1_000_000)

    def finished(no, held, ended):
        """A capture that holds no chunk counts, but there is nothing to give out."""
        if held is None:
            return []
        return [{"utt_no": no, col: _padded(held, rate, chunk), "ended_by": "speech_end" if ended else "timeout"}]

    def step(state, rows):
        begun, ended, held, front, no = state if state else (None, False, None, None, 0)
        held, out = None if held is None else list(held), []
        for row in rows:
            if row["row_kind"] == 0:
                if begun is None:
                    begun, ended, held = row[AT], False, None if front is None else list(front)
            elif row["row_kind"] == 1:
                ended = ended or begun is not None
            else:
                front = list(row[col] or [])
                if begun is None:
                    continue
                held = (held or []) + front
                if ended or (timeout > 0 and row[AT] - begun >= limit):
                    no += 1
                    out += finished(no, held, ended)
                    begun, ended, held = None, False, None
        return (begun, ended, held, front, no), out

    def due(state):
        return state[0] + limit if state[0] is not None and timeout > 0 else None

    def expire(state, moment):
        _, ended, held, front, no = state
        return (None, False, None, front, no + 1), finished(no + 1, held, ended)

    kind = audio.schema[col].dataType.simpleString()
    state = f"begun bigint, ended boolean, held {kind}, front {kind}, no bigint"
    columns = [("utt_no", "bigint"), (col, kind), ("ended_by", "string")]
    own = (due, expire) if timer else (None, None)
    return in_order(merged, key, ts, state, columns, step, delay, ["row_kind"], None, *own, bucket_ms)


def _padded(held: list, rate: int, chunk: int) -> list:
    return held + [0.0] * max(0, chunk + rate - len(held)) if 0 < rate and len(held) < rate else held


def speech_utterance_stream(
    audio: DataFrame, key: str, ts: str, prob: str, col: str = "samples", t: float = SPEECH, margin: float = MARGIN,
    min_silence: int = MIN_SILENCE, pad: int = SPEECH_PAD, frame: int = FRAME, rate: int = SAMPLE_RATE, chunk: int = AUDIO_CHUNK,
    delay: str = "10 seconds", tie=(), bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Utterances from speech start to speech end in a stream: (key, utt_no, samples, ended_by).

    The detector of ``hysteresis_stream`` stands in front of the capture in one keyed state: chunk i of a key ends at
    position i * ``frame`` and is a frame of the detector as well. Gives what ``speech_captures`` and
    ``assemble_utterances`` give over these positions. Chunks are held back only as far as a start may reach back;
    ``min_silence`` must keep segments apart.
    """
    if min_silence + frame <= 2 * pad:
        raise ValueError("min_silence + frame must exceed 2 * pad, so that segments do not overlap")
    hear, reach = _detector(t, margin, min_silence, pad, frame), pad // frame + 2

    def step(state, rows):
        *heard, places, chunks, no = state if state else (0, 0, None, None, [], [], 0)
        places, chunks, out = list(places), [list(c) for c in chunks], []
        for row in rows:
            heard, ended = hear(heard, row[prob])
            places.append(heard[0])
            chunks.append(list(row[col] or []))
            if ended:
                _, start, end = ended
                first = max((i for i, p in enumerate(places) if p < start), default=0)
                inside = [c for p, c in zip(places[first:], chunks[first:]) if p <= end]
                no += 1
                if inside:
                    out.append({"utt_no": no, col: _padded([x for c in inside for x in c], rate, chunk), "ended_by": "speech_end"})
            if heard[2] is None:
                places, chunks = places[-reach:], chunks[-reach:]
        return (*heard, places, chunks, no), out

    kind = audio.schema[col].dataType.simpleString()
    state = f"at bigint, segment bigint, start bigint, pending bigint, places array<bigint>, chunks array<{kind}>, no bigint"
    columns = [("utt_no", "bigint"), (col, kind), ("ended_by", "string")]
    return in_order(audio.select(key, ts, prob, col, *tie), key, ts, state, columns, step, delay, tie, bucket_ms=bucket_ms)


def stage_stream(
    state_log: DataFrame, key: str, ts: str, state: str = "state", limits: dict | None = None, delay: str = "10 seconds",
    tie=(), bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Stream form of ``stage_durations`` that reports a stage at its deadline, while it is still open.

    Rows with a true ``open`` are such reports: ``seconds`` is the limit, ``timed_out`` is true. The next state cancels
    a deadline that has not come; a state at the very moment is in time. The other rows are those of the batch form,
    each given out when the next state is there, the last one of a key at an end marker.
    """
    limits = {k: round(v * 1_000_000) for k, v in (STAGE_LIMITS if limits is None else limits).items()}
    columns = _timed(state_log, key, ts)
    names = [AT if n == ts else n for n, _ in columns]

    def result(row, seconds, over, still):
        return {**row, "seconds": seconds, "timed_out": over, "open": still}

    def step(held, rows):
        out = []
        for row in rows:
            if held:
                last = dict(zip(names, held))
                passed = row[AT] - last[AT]
                out.append(result(last, passed / 1_000_000, passed > limits.get(last[state], passed), False))
            held = (*(row[n] for n in names), False)
        return held, out

    def due(held):
        last = dict(zip(names, held))
        return None if held[-1] or last[state] not in limits else last[AT] + limits[last[state]]

    def expire(held, moment):
        last = dict(zip(names, held))
        return (*held[:-1], True), [result(last, limits[last[state]] / 1_000_000, True, True)]

    def close(held):
        return [result(dict(zip(names, held)), None, False, False)]

    kept = ", ".join(f"`{n}` {'bigint' if n == AT else k}" for n, (_, k) in zip(names, columns)) + ", reported boolean"
    added = [("seconds", "double"), ("timed_out", "boolean"), ("open", "boolean")]
    return in_order(state_log, key, ts, kept, columns + added, step, delay, tie, close, due, expire, bucket_ms)
