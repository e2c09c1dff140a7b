"""Cutting utterances out of an audio stream.

A capture starts at an accepted trigger, or at a speech start if there are no
triggers, and ends with the chunk in which speech ends or the time is up. The
chunk before the capture is put in front. Captures of a stream do not overlap, so
finding the capture of a chunk is a fill-forward, not an interval join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.numbers import AUDIO_CHUNK, SAMPLE_RATE, micros, pad_short
from colloquy.operators.gating import accept
from colloquy.operators.ordered import RUN_ROWS, arrange, longest_key

# Fixed value: longest recording after a trigger, in seconds.
CAPTURE_TIMEOUT = 6.0


def _next_after(probes: DataFrame, marks: DataFrame, key: list, probe: str, out: str, run_rows: int, bound: int) -> DataFrame:
    """Add to each probe the first mark at or after its ``probe`` moment."""
    asked = probes.select(*key, F.col(probe).alias("_v"), F.lit(0).alias("_kind"), F.struct(*probes.columns).alias("_row"))
    given = marks.select(*key, F.col("_mark").alias("_v"), F.lit(1).alias("_kind"), "_mark")
    both = asked.unionByName(given, allowMissingColumns=True)
    found = arrange(both, key, ["_v", "_kind"], run_rows, bound).next_value("_mark", out).result()
    return found.where("_kind = 0").select("_row.*", out)


def trigger_captures(
    audio: DataFrame, triggers: DataFrame, speech_ends: DataFrame, key, ts: str = "ts",
    timeout: float = CAPTURE_TIMEOUT, run_rows: int = RUN_ROWS, timer: bool = False,
) -> DataFrame:
    """Captures of accepted triggers: (key, utt_no, start_us, end_us, ended_by).

    The end is the first chunk at which speech ends or ``timeout`` seconds have
    passed; ``speech_ends`` holds the moments of the chunks in which speech ended. A trigger during a capture, its last
    chunk included, is ignored. A capture whose end has not come yet is not returned. Rows without a time are left out.

    With ``timer`` time runs out by itself: a capture in which speech has not ended by then ends at its trigger plus
    ``timeout``, be there a later chunk or not.
    """
    key = [key] if isinstance(key, str) else list(key)
    probes = triggers.select(*key, micros(triggers, ts).alias("start_us")).where("start_us IS NOT NULL")
    probes = probes.withColumn("_due", F.col("start_us") + int(timeout * 1_000_000))
    ends = speech_ends.select(*key, micros(speech_ends, ts).alias("_mark")).where("_mark IS NOT NULL")
    chunks = audio.select(*key, micros(audio, ts).alias("_mark")).where("_mark IS NOT NULL")
    bound = longest_key(probes.select(*key).unionByName(ends.select(*key)).unionByName(chunks.select(*key)), key)
    timed = _next_after(probes, ends, key, "start_us", "_end", run_rows, bound)
    if timer and timeout > 0:
        timed = timed.withColumn("_late", F.col("_due"))
    elif timeout > 0:
        timed = _next_after(timed, chunks, key, "_due", "_late", run_rows, bound)
    else:
        timed = timed.withColumn("_late", F.lit(None).cast("bigint"))
    by_speech = F.col("_end").isNotNull() & (F.col("_late").isNull() | (F.col("_end") <= F.col("_late")))
    bounded = timed.select(
        *key, "start_us", F.least("_end", "_late").alias("end_us"),
        F.when(by_speech, "speech_end").otherwise("timeout").alias("ended_by"),
    ).withColumn("_until", F.col("end_us") + 1)
    taken = accept(arrange(bounded, key, "start_us", run_rows, bound), "_until")
    closed = taken.with_df(taken.df.drop("_until").where("end_us IS NOT NULL"))
    return closed.running_sum(F.lit(1), "utt_no").result().select(*key, "utt_no", "start_us", "end_us", "ended_by")


def speech_captures(segments: DataFrame, key, start: str, end: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """Captures from speech start to speech end, for use without triggers."""
    key = [key] if isinstance(key, str) else list(key)
    closed = segments.where(F.col(end).isNotNull())
    timed = closed.select(
        *key, micros(segments, start).alias("start_us"), micros(segments, end).alias("end_us"),
        F.lit("speech_end").alias("ended_by"),
    )
    return arrange(timed, key, "start_us", run_rows).running_sum(F.lit(1), "utt_no").result()


def capture_chunks(audio: DataFrame, captures: DataFrame, key, ts: str = "ts", run_rows: int = RUN_ROWS) -> DataFrame:
    """Each chunk with the capture it belongs to, the chunk in front included.

    A chunk that ends one capture can also be the one in front of the next, or of several if no chunk lies between.
    """
    key = [key] if isinstance(key, str) else list(key)
    heads = captures.select(
        *key, F.col("start_us").alias("_at"), F.lit(0).alias("_kind"),
        F.struct("utt_no", "start_us", "end_us", "ended_by").alias("_head"),
    )
    chunks = audio.select(*key, micros(audio, ts).alias("_at"), F.lit(1).alias("_kind"), F.struct(*audio.columns).alias("_row"))
    bound = longest_key(audio.select(*key).unionByName(captures.select(*key)), key)
    rows = arrange(heads.unionByName(chunks, allowMissingColumns=True), key, ["_at", "_kind"], run_rows, bound)
    chunk = F.when(F.col("_kind") == 1, F.struct("_at", "_row"))
    rows = rows.last_value("_head", "_inside").last_value(chunk, "_before").result()
    inside = F.when(F.col("_at") <= F.col("_inside.end_us"), F.struct(F.col("_inside").alias("c"), chunk.alias("b")))
    front = F.when(F.col("_before").isNotNull(), F.struct(F.col("_head").alias("c"), F.col("_before").alias("b")))
    kept = rows.select(F.when(F.col("_kind") == 1, inside).otherwise(front).alias("_m")).where("_m IS NOT NULL")
    return kept.select("_m.b._row.*", "_m.c.*", "_m.b._at")


def assemble_utterances(
    audio: DataFrame, captures: DataFrame, key, ts: str = "ts", col: str = "samples",
    rate: int = SAMPLE_RATE, chunk: int = AUDIO_CHUNK, run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Utterances: (key, utt_no, samples, ended_by), short ones padded with zeros."""
    key = [key] if isinstance(key, str) else list(key)
    chunks = capture_chunks(audio, captures, key, ts, run_rows)
    joined = chunks.groupBy(*key, "utt_no").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("_at", F.coalesce(F.col(col), F.array().cast(audio.schema[col].dataType)).alias("_s"))))["_s"]).alias(col),
        F.first("ended_by").alias("ended_by"),
    )
    return joined.withColumn(col, pad_short(col, rate, chunk))
