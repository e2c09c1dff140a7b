"""Operators over time-ordered samples and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.numbers import micros
from colloquy.operators.ordered import RUN, RUN_ROWS, arrange

# Frame length, speech threshold, hysteresis margin, silence and
# padding in milliseconds at 16 samples each.
FRAME = 512
SPEECH = 0.5
MARGIN = 0.15
SAMPLES_PER_MS = 16
MIN_SILENCE = 100 * SAMPLES_PER_MS
SPEECH_PAD = 30 * SAMPLES_PER_MS
DEPLOYED_MIN_SILENCE = 1048 * SAMPLES_PER_MS
DEPLOYED_SPEECH_PAD = 32 * SAMPLES_PER_MS


def reframe(df: DataFrame, key, order, col: str = "samples", frame: int = FRAME, run_rows: int = RUN_ROWS) -> DataFrame:
    """Chunks of any length to frames of ``frame`` samples: (key, frame_no, samples).

    A running sum of lengths places each chunk; the chunk is cut at frame borders
    and the pieces of a frame, at most ``frame`` of them, meet again. A frame that
    is never filled is dropped.
    """
    key = [key] if isinstance(key, str) else list(key)
    filled = df.where(F.size(col) > 0).withColumn("_len", F.size(col))
    placed = arrange(filled, key, order, run_rows).running_sum("_len", "_stop").result()
    begin = F.col("_stop") - F.col("_len")
    covered = F.sequence(F.floor(begin / frame), F.floor((F.col("_stop") - 1) / frame))
    pieces = placed.select(*key, begin.alias("_begin"), "_len", col, F.explode(covered).alias("frame_no"))
    low = F.greatest(F.col("frame_no") * frame - F.col("_begin"), F.lit(0))
    high = F.least((F.col("frame_no") + 1) * frame - F.col("_begin"), F.col("_len"))
    cut = F.slice(F.col(col), (low + 1).cast("int"), (high - low).cast("int"))
    parts = pieces.select(*key, "frame_no", (F.col("_begin") + low).alias("_at"), cut.alias("_piece"))
    whole = parts.groupBy(*key, "frame_no").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("_at", "_piece")))["_piece"]).alias(col)
    )
    return whole.where(F.size(col) == frame)


def with_preroll(df: DataFrame, key, order, col: str = "samples", out: str = "with_preroll", run_rows: int = RUN_ROWS) -> DataFrame:
    """Put the chunk before in front of each chunk."""
    before = arrange(df, key, order, run_rows).lag(col, "_before").result()
    return before.withColumn(out, F.when(F.col("_before").isNull(), F.col(col)).otherwise(F.concat("_before", col))).drop("_before")


def hysteresis_segments(
    df: DataFrame, key, order, prob: str, t: float = SPEECH, margin: float = MARGIN,
    min_silence: int = MIN_SILENCE, pad: int = SPEECH_PAD, frame: int = FRAME, clip: bool = False,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Speech segments of frame probabilities: (key, segment, start_pos, end_pos, n_frames).

    A frame at or above ``t`` always leaves the detector in speech with no end
    pending. So the frames from one such frame to the next form a group that
    needs no memory: its first frame below ``t - margin`` is the pending end, and
    the end is real if another low frame follows ``min_silence`` later. Groups are
    partial aggregates, segments are the stretches between groups that ended.
    A segment still open at the end has a null ``end_pos``.
    """
    key = [key] if isinstance(key, str) else list(key)
    rows = arrange(df, key, order, run_rows).running_sum(F.lit(frame), "_pos")
    rows = rows.running_sum(F.when(F.col(prob) >= t, 1).otherwise(0), "_group")
    low = F.when(F.col(prob) < t - margin, F.col("_pos"))
    groups = rows.df.where("_group > 0").groupBy(*key, "_group").agg(
        F.min("_pos").alias("_high"), F.min(low).alias("_first"), F.max(low).alias("_last"),
        F.min(RUN).alias(RUN), F.count("*").alias("_n"),
    )
    ended = F.coalesce(F.col("_last") - F.col("_first") >= min_silence, F.lit(False))
    marked = rows.with_df(groups.withColumn("_ended", ended), "_group").lag("_ended", "_after")
    opens = F.coalesce("_after", F.lit(True))
    numbered = marked.running_sum(F.when(opens, 1).otherwise(0), "segment")
    start = F.col("_high") - pad - frame
    out = numbered.result().groupBy(*key, "segment").agg(
        F.min(F.greatest(start, F.lit(0)) if clip else start).alias("start_pos"),
        F.max(F.when(F.col("_ended"), F.col("_first") + pad - frame)).alias("end_pos"),
        F.sum("_n").alias("n_frames"),
    )
    return out


def with_epoch(df: DataFrame, resets: DataFrame, key, ts: str, out: str = "epoch", run_rows: int = RUN_ROWS) -> DataFrame:
    """Number of resets of the key at or before each row.

    A detector starts anew after a reset (a trigger, or a switch turned), so the
    segments or frames with resets are those of the key (key, epoch).
    """
    key = [key] if isinstance(key, str) else list(key)
    rows = df.select(*key, micros(df, ts).alias("_at"), F.lit(1).alias("_kind"), F.struct(*df.columns).alias("_row"))
    marks = resets.select(*key, micros(resets, ts).alias("_at"), F.lit(0).alias("_kind"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    counted = arrange(both, key, ["_at", "_kind"], run_rows).running_sum(1 - F.col("_kind"), "_resets").result()
    return counted.where("_kind = 1").select("_row.*", F.col("_resets").cast("bigint").alias(out))


def while_enabled(
    df: DataFrame, switches: DataFrame, key, ts: str, initial: bool = False, enabled: str = "enabled",
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Rows whose last switch event before them says on; a switch counts from its
    own moment. ``switches`` has the key, ``ts`` and a boolean column ``enabled``."""
    key = [key] if isinstance(key, str) else list(key)
    rows = df.select(*key, micros(df, ts).alias("_at"), F.lit(1).alias("_kind"), F.struct(*df.columns).alias("_row"))
    turns = switches.select(
        *key, micros(switches, ts).alias("_at"), F.lit(0).alias("_kind"), F.col(enabled).alias("_on")
    )
    both = rows.unionByName(turns, allowMissingColumns=True)
    known = arrange(both, key, ["_at", "_kind"], run_rows).last_value("_on", "_state").result()
    kept = known.where((F.col("_kind") == 1) & F.coalesce("_state", F.lit(initial)))
    return kept.select("_row.*")


def latest_score(df: DataFrame, key, ts: str, score: str) -> DataFrame:
    """Last score per key (a model, or stream and model); of several at one moment the largest. A partial aggregate."""
    key = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*key).agg(F.max(ts).alias(ts), F.max_by(score, F.struct(ts, score)).alias(score))
