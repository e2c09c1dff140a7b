"""One query per operator over the given tables, named after its function.

Timestamps are returned as microseconds and arrays as text, so that results can
be compared value by value with another engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import (
    audio_seconds, clean_text, cosine_distance, fit_length, float_to_pcm16, format_ticks, lstrip_set, micros,
    min_length, pad_short, pcm_to_float, regex_trim, smooth_labels, too_short,
)
from colloquy.operators import (
    chunking, dialogue, documents, embedding, gating, keyword_tables, labelled, prompts, quantiles, retrieval, signals, transcripts,
    utterances,
)
from colloquy.plans import ingestion
from colloquy.plans.answering import rag_prompts
from colloquy.runtime import materialize, shared_dir, small_side, spread, text_tasks
from colloquy.sources import index, plugin, versions
from colloquy.sources.files import drop_comments, scan_documents
from colloquy.sources.store import dump_chunks, insert_new, open_chunks, write_chunks
from colloquy.streaming import signals as streams
from colloquy.streaming.stateful import end_marker, event_time

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

DAY = 86400.0
DAY_MS = 86_400_000
QUIET = 30_000.0  # seconds
SETTINGS = {"chunk_size": chunking.DEPLOYED_CHUNK_SIZE, "overlap": chunking.DEPLOYED_CHUNK_OVERLAP}
EVENT_ROLES = {"click": "trigger", "view": "transcript", "purchase": "answer", "signup": "done", "error": "failure"}
LSH = {"tables": 16, "bits": 4, "seed": 7}
PROBES = 6
SPLITS = {0: {"train": 100, "validation": 20}, 1: {"train": 150, "validation": 30}}
MIX = {0: 10, 1: 25}
PHRASES = {"targets": ["the", "der", "la"], "negatives": ["of", "und", "le"]}
WAKE_PHRASES = ["Hello Robot", "Good morning Computer", "Are you there"]
GREETINGS = ["Hello", "Hey", "Good morning", "Good afternoon", "Good evening"]
KEYWORDS = [*(f"{greeting} {name}" for greeting in GREETINGS for name in ("Robot", "Computer")), "Are you there"]
SPEECH = {"t": 0.5, "margin": 0.15, "min_silence": 1024, "pad": 512, "frame": 512}


def query(fn: Query) -> Query:
    CATALOG[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def flat(col, scale: int = 1_000_000) -> Column:
    """Numbers of an array as text, scaled to whole numbers."""
    col = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(col, lambda x: F.round(x.cast("double") * scale).cast("bigint").cast("string")), ",")


def docs(spark, sf):
    return spread(table(spark, sf, "documents"))


def questions(spark, sf):
    said = spread(table(spark, sf, "conversations")).where("role = 'user'")
    return said.select((F.col("conv_id") * 100000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


def packed(spark, sf):
    cut = chunking.pack_sentences(docs(spark, sf), **SETTINGS)
    return cut.withColumn("chunk_id", F.concat_ws("-", "doc_id", "pos"))


def timed_events(spark, sf):
    ev = table(spark, sf, "events")
    return ev.withColumn("ts_us", micros(ev, "ts"))


# ---- sources, sinks, bookkeeping

@query
def scan_texts(spark, sf):
    path = f"{shared_dir(spark).rstrip('/')}/colloquy/{uuid.uuid4().hex}"
    table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").option(
        "maxRecordsPerFile", 10_000
    ).text(path)
    files = scan_documents(spark, path)
    lines = files.select(
        F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"), F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line")  # the file's last line feed ends a line
    )
    return lines


@query
def drop_comment_lines(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return drop_comments(lines, "line")


@query
def append_tables(spark, sf):
    li = table(spark, sf, "lineitem")
    cell = F.when(F.col("l_returnflag") == "N", F.lit(None)).when(F.col("l_returnflag") == "A", "").otherwise(
        F.concat_ws(" | ", "l_linenumber", "l_partkey", "l_linestatus")
    )
    tables = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", cell.alias("detailed_content")))).alias("tables")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("text"))
    return documents.append_tables(orders.join(tables, "o_orderkey")).select("o_orderkey", "text")


@query
def scalar_metadata(spark, sf):
    ev = table(spark, sf, "events")
    raw = F.concat(
        F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "kind": "'), F.col("event_type"),
        F.lit('", "tags": [1, 2], "inner": {"a": 1}, "ok": '), (F.col("value") > 40).cast("string"),
        F.lit(', "none": null, "half": 0.5}'),
    )
    flat_map = documents.scalar_metadata(ev.select("event_id", raw.alias("j")), "j")
    return flat_map.select("event_id", F.explode("metadata").alias("key", "value"))


@query
def write_and_open_chunks(spark, sf):
    path = f"{shared_dir(spark).rstrip('/')}/colloquy/{uuid.uuid4().hex}"
    said = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), "text"
    )
    stored = docs(spark, sf).select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    write_chunks(said, path, wipe=True)
    write_chunks(stored, path, wipe=True)
    write_chunks(said, path)
    return open_chunks(spark, path, "chunk_id string, text string")


@query
def insert_new_entries(spark, sf):
    every = docs(spark, sf).select("doc_id", "lang", "text")
    return insert_new(every.where("lang = 'en'").withColumn("text", F.lit("stored")), every, "doc_id")


@query
def assign_batches(spark, sf):
    return documents.assign_batches(docs(spark, sf).select("source", "doc_id"), ["source", "doc_id"])


@query
def dump_chunk_texts(spark, sf):
    return dump_chunks(docs(spark, sf))


@query
def ingest_report(spark, sf):
    every = docs(spark, sf)
    cut = chunking.pack_sentences(every, **SETTINGS).join(every.select("doc_id", "lang"), "doc_id")
    return documents.ingest_report(every, cut, "lang").select("lang", "documents", "chunks")


# ---- chunking and embedding

@query
def split_sentences(spark, sf):
    return chunking.split_sentences(docs(spark, sf))


@query
def buffer_sentences(spark, sf):
    return chunking.buffer_sentences(chunking.split_sentences(docs(spark, sf))).select("doc_id", "pos", "buffered")


@query
def hash_embed(spark, sf):
    return embedding.hash_embed(table(spark, sf, "documents"), "doc_id", "text").select(
        "doc_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


@query
def embed(spark, sf):
    dense = embedding.embed(docs(spark, sf).select("doc_id", "text"), "text", dim=64)
    return dense.select("doc_id", flat("embedding").alias("embedding"))


def _distances(spark, sf):
    every = table(spark, sf, "documents").select("doc_id", "text")
    placed = every.repartition(text_tasks(every, "text"), "doc_id")
    return chunking.adjacent_distance(chunking.sentence_counts(placed))


@query
def adjacent_distance(spark, sf):
    return _distances(spark, sf)


@query
def breakpoint_threshold(spark, sf):
    return chunking.breakpoint_threshold(_distances(spark, sf))


@query
def semantic_chunks(spark, sf):
    return chunking.semantic_chunks(table(spark, sf, "documents"))


@query
def pack_sentences(spark, sf):
    return chunking.pack_sentences(docs(spark, sf), **SETTINGS)


@query
def token_windows(spark, sf):
    return chunking.token_windows(docs(spark, sf), "doc_id", "text", 100, 20)


@query
def chunk_documents(spark, sf):
    return chunking.chunk_documents(table(spark, sf, "documents"), **SETTINGS)


@query
def build_chunks(spark, sf):
    every = table(spark, sf, "documents").select("doc_id", "text")
    made = ingestion.build_chunks(ingestion.prepare_documents(every), **SETTINGS)
    return made.select("chunk_id", "doc_id", "pos", "n_tokens", "content_hash")


@query
def update_collection(spark, sf):
    """The English documents, then all of them."""
    path = f"{shared_dir(spark).rstrip('/')}/colloquy/{uuid.uuid4().hex}"
    every = table(spark, sf, "documents").select("doc_id", "text", "lang")
    for part in (every.where("lang = 'en'"), every):
        ingestion.update_collection(spark, part, path, **SETTINGS)
    return open_chunks(spark, path).select("chunk_id", "doc_id", "pos", "n_tokens", "content_hash")


@query
def versioned_collection(spark, sf):
    """Two states of a source: rows of remainder 1 are rewritten, 2 removed, 3 touched with the same text, 0 new in the second."""
    path = f"{shared_dir(spark).rstrip('/')}/colloquy/{uuid.uuid4().hex}"
    every = table(spark, sf, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(7)).alias("kind"))

    def state(second: bool) -> DataFrame:
        text = F.when((F.col("kind") == 1) & F.lit(second), F.concat("text", F.lit(" It was revised."))).otherwise(F.col("text"))
        seen = F.when(F.col("kind").isin(1, 3) & F.lit(second), 2).otherwise(1)
        rows = every.where(F.col("kind") != (2 if second else 0))
        return rows.select(F.col("doc_id").cast("string").alias("path"), F.timestamp_seconds(seen).alias("modified"), F.length(text).cast("bigint").alias("size"), text.alias("text"))

    for second in (False, True):
        rows = state(second)
        versions.synchronize(spark, rows, lambda paths, rows=rows: rows.join(small_side(paths), "path", "left_semi").select("path", "text"), path, **SETTINGS)
    first = versions.snapshot(spark, path, 1).groupBy("path").agg(F.count("*").alias("before"))
    homes = versions.entries(spark, path).select("path", "version")
    now = versions.snapshot(spark, path).join(homes, "path").join(first, "path", "left")
    return now.select(F.col("path").cast("bigint").alias("doc_id"), F.col("pos"), "n_tokens", "content_hash", "version", "before")


@query
def plugged_store(spark, sf):
    """Turns written through the pluggable source in two commits and read back."""
    plugin.register(spark)
    path = f"{shared_dir(spark).rstrip('/')}/colloquy/{uuid.uuid4().hex}"
    turns = spread(table(spark, sf, "conversations")).select(
        F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("pos"), "text",
        F.size(F.split("text", " ")).alias("n_tokens"), F.md5("text").alias("content_hash"), F.array(F.lit(0.5).cast("float")).alias("embedding"),
        F.create_map(F.lit("role"), "role").alias("metadata"),
    )
    for part in (turns.where("metadata['role'] = 'user'"), turns.where("metadata['role'] <> 'user'")):
        part.write.format(plugin.FORMAT).mode("append").option("path", path).save()
    read = spark.read.format(plugin.FORMAT).option("path", path).load()
    return read.select("chunk_id", "doc_id", "pos", "text", "content_hash", F.col("metadata")["role"].alias("role"))


@query
def own_embedder(spark, sf):
    @F.pandas_udf("array<float>")
    def sizes(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts])

    return embedding.embed(docs(spark, sf), "text", sizes).select("doc_id", flat("embedding", 1).alias("embedding"))


@query
def new_chunks(spark, sf):
    marked = chunking.chunk_fingerprint(
        docs(spark, sf).withColumn("chunk_id", F.col("doc_id").cast("string")), SETTINGS
    )
    fresh = chunking.new_chunks(marked, marked.where("lang = 'en'"))
    return fresh.select("doc_id", "content_hash")


# ---- retrieval and prompts

def _vectors(spark, sf):
    every = table(spark, sf, "embeddings")
    return (
        every.select(F.col("vec_id").alias("chunk_id"), "embedding"),
        every.select(F.col("vec_id").alias("query_id"), "embedding"),
    )


@query
def cosine_neighbours(spark, sf):
    every = table(spark, sf, "embeddings")
    after = every.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return every.join(after, "vec_id").select(
        "vec_id", F.round(cosine_distance("embedding", "other"), 9).alias("distance")
    )


@query
def topk_search(spark, sf):
    return retrieval.topk_search(*_vectors(spark, sf))


@query
def relevance_filter(spark, sf):
    return retrieval.relevance_filter(retrieval.topk_search(*_vectors(spark, sf), k=5), retrieval.DEPLOYED_RELEVANCE)


@query
def lsh_topk(spark, sf):
    return retrieval.lsh_topk(*_vectors(spark, sf), **LSH)


def _indexed(spark, sf) -> str:
    """An index of the rows not divisible by 5, brought to the state of those whose remainder by 7 is not 3."""
    root = f"{shared_dir(spark).rstrip('/')}/colloquy/{uuid.uuid4().hex}"
    vectors = _vectors(spark, sf)[0]
    for state in ("chunk_id % 5 <> 0", "chunk_id % 7 <> 3"):
        index.update_index(spark, vectors.where(state), root)
    return root


@query
def index_topk(spark, sf):
    return index.index_topk(spark, _indexed(spark, sf), _vectors(spark, sf)[1], probes=PROBES)


@query
def index_exact(spark, sf):
    return index.index_topk(spark, _indexed(spark, sf), _vectors(spark, sf)[1], exact=True)


def _nearest(spark, sf):
    """Hits of every question: as many documents as its turn has turns before it."""
    said = table(spark, sf, "conversations").where("role = 'user' AND turn > 0")
    ranks = F.explode(F.sequence(F.lit(1), F.col("turn").cast("int"))).alias("rank")
    hits = said.select((F.col("conv_id") * 100000 + F.col("turn")).alias("query_id"), "conv_id", ranks)
    return hits.select("query_id", "rank", (F.col("conv_id") * 3 + F.col("rank")).cast("bigint").alias("chunk_id"))


@query
def assemble_context(spark, sf):
    chunks = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")
    asked = questions(spark, sf)
    return prompts.assemble_context(asked, _nearest(spark, sf), chunks).select("query_id", "context")


@query
def build_prompt(spark, sf):
    said = table(spark, sf, "conversations")
    given = said.select(
        "conv_id", "turn", F.col("text").alias("query"),
        F.when(F.col("role") == "assistant", F.col("text")).when(F.col("role") == "user", "").alias("context"),
    )
    return prompts.build_prompt(given).select("conv_id", "turn", "prompt")


@query
def direct_prompts(spark, sf):
    return prompts.direct_prompts(questions(spark, sf)).select("query_id", "prompt")


@query
def grounded_prompts(spark, sf):
    # the collection is stored once and then read for search and for contexts
    stored = materialize(embedding.embed(packed(spark, sf).select("chunk_id", "text"), "text"))
    return rag_prompts(stored, questions(spark, sf)).select("query_id", "context", "prompt")


@query
def request_stats(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("event_type").alias("route"), (F.col("value") <= 100).alias("succeeded"), F.col("value").alias("seconds")
    )
    stats = prompts.request_stats(log)
    return stats.select("route", "n", "n_failed", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95")])


# ---- transcripts

def _said(spark, sf):
    return spread(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "text")


@query
def clean_transcripts(spark, sf):
    return _said(spark, sf).select(
        "conv_id", "turn", clean_text("text").alias("cleaned"),
        lstrip_set(F.concat(F.lit(" .,!? "), F.col("text"))).alias("rest"),
    )


def _greeted(spark, sf):
    """Transcripts that start with a greeting, sometimes misspelt, by role."""
    head = F.when(F.col("role") == "user", "Hello  Robot, ").when(F.col("role") == "assistant", "God morning computer! ")
    return _said(spark, sf).select("conv_id", "turn", F.concat(F.coalesce(head, F.lit("")), F.col("text")).alias("text"))


@query
def partial_ratio(spark, sf):
    said = _said(spark, sf).withColumn("text", F.lower("text"))
    scored = transcripts.partial_ratio(said, "text", "good morning robot")
    return scored.select("conv_id", "turn", F.round("score", 6).alias("score"), F.col("end").cast("bigint").alias("end"))


@query
def best_keyword(spark, sf):
    said = _said(spark, sf).withColumn("text", F.lower("text"))
    best = transcripts.best_keyword(said, "text", KEYWORDS, 55)
    return best.select(
        "conv_id", "turn", "keyword", F.round("score", 6).alias("score"), F.col("end").cast("bigint").alias("end")
    )


@query
def keyword_table(spark, sf):
    """Every nation's name is a phrase; texts start with one that has lost a letter."""
    nation = table(spark, sf, "nation")
    said = _said(spark, sf).join(small_side(nation), F.col("n_nationkey") == (F.col("conv_id") + F.col("turn")) % 25)
    named = F.concat(F.lit("From "), F.expr("replace(n_name, 'I', '')"), F.lit(". "), F.col("text"))
    found = keyword_tables.best_of_table(said.select("conv_id", "turn", F.lower(named).alias("text")), "text", nation, "n_name", "n_nationkey", 80)
    return found.select("conv_id", "turn", "keyword", F.round("score", 6).alias("score"), F.col("end").cast("bigint").alias("end"))


@query
def strip_wakeword(spark, sf):
    return transcripts.strip_wakeword(_greeted(spark, sf), "text", WAKE_PHRASES).select("conv_id", "turn", "matched", "rest")


@query
def min_length_filter(spark, sf):
    words = docs(spark, sf).select("doc_id", F.posexplode(chunking.sentences_of("text")).alias("pos", "sentence"))
    return words.where(min_length("sentence"))


@query
def assemble_transcript(spark, sf):
    turns = _said(spark, sf)
    tokens = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("conv_id"), F.col("l_discount").alias("prob"))
    return transcripts.assemble_transcript(turns, tokens, "conv_id", "turn").withColumn("prob", F.round("prob", 6))


@query
def trim_text(spark, sf):
    return docs(spark, sf).select("doc_id", regex_trim(F.concat(F.lit("\t "), F.col("text"), F.lit(" \n"))).alias("text"))


@query
def tick_format(spark, sf):
    ticks = F.col("event_id") * 7919 + F.floor(F.col("value") * 100).cast("bigint")
    return table(spark, sf, "events").select(
        "event_id", format_ticks(ticks).alias("point"), format_ticks(ticks, comma=True).alias("comma")
    )


@query
def audio_length(spark, sf):
    samples = F.flatten(F.array_repeat(F.col("embedding"), F.col("label") + 20))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(audio_seconds(samples), 6).alias("seconds"), too_short(samples).alias("too_short")
    )


# ---- samples and scores

@query
def samples_to_float(spark, sf):
    peak = {"int32": 2147483647.0, "int16": 32767.0, "int8": 127.0}
    kinds = [*peak, "uint8", "float32", "int24"]
    vectors = table(spark, sf, "embeddings")
    fmt = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("label") % len(kinds) + 1).cast("int"))
    raw = F.transform(
        "embedding",
        lambda x: F.when(F.col("fmt") == "float32", x.cast("double"))
        .when(F.col("fmt") == "uint8", F.round((x.cast("double") + 1) * 127))
        .otherwise(F.round(x.cast("double") * F.coalesce(F.try_element_at(F.create_map(
            *[F.lit(v) for p in peak.items() for v in p]), F.col("fmt")), F.lit(1.0)))),
    )
    typed = vectors.withColumn("fmt", fmt).withColumn("raw", raw)
    out = typed.withColumn("samples", pcm_to_float("raw", "fmt")).where("samples IS NOT NULL")
    return out.select("vec_id", "fmt", flat("samples", 100_000).alias("samples"))


@query
def samples_to_pcm16(spark, sf):
    loud = F.transform("embedding", lambda x: x * 4)
    return table(spark, sf, "embeddings").select("vec_id", flat(float_to_pcm16(loud), 1).alias("samples"))


@query
def reframe(spark, sf):
    frames = signals.reframe(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 24)
    return frames.select("label", "frame_no", flat("embedding").alias("samples"))


@query
def with_preroll(spark, sf):
    joined = signals.with_preroll(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return joined.select("vec_id", flat("with_preroll").alias("samples"))


@query
def pad_short_captures(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return vectors.select("vec_id", flat(pad_short("embedding", 64 + F.col("label") - 3, F.lit(8))).alias("samples"))


@query
def debounce(spark, sf):
    scores = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    kept = gating.debounce(scores, "user_id", "ts", "value", 20.0, DAY, "event_id")
    return kept.select("user_id", "event_id", micros(kept, "ts").alias("ts_us"))


@query
def gate_triggers(spark, sf):
    clicks = table(spark, sf, "events").where("event_type = 'click'").select(
        "user_id", "event_id", "ts", (F.col("value") * 3600).alias("busy")
    )
    kept = gating.gate_triggers(clicks, "user_id", "ts", "busy", "event_id")
    return kept.select("user_id", "event_id", micros(kept, "ts").alias("ts_us"))


@query
def hysteresis_segments(spark, sf):
    frames = table(spark, sf, "events").withColumn("prob", F.least(F.lit(1.0), F.col("value") / 100))
    return signals.hysteresis_segments(frames, "user_id", ["ts", "event_id"], "prob", **SPEECH).select(
        "user_id", "segment", "start_pos", "end_pos"
    )


RESET_SPEECH = {**SPEECH, "t": 0.3, "min_silence": 512}


@query
def hysteresis_resets(spark, sf):
    """Clicks reset the detector."""
    ev = table(spark, sf, "events").withColumn("prob", F.least(F.lit(1.0), F.col("value") / 100))
    frames = signals.with_epoch(ev.where("event_type <> 'click'"), ev.where("event_type = 'click'"), "user_id", "ts")
    found = signals.hysteresis_segments(frames, ["user_id", "epoch"], ["ts", "event_id"], "prob", **RESET_SPEECH)
    return found.select("user_id", "epoch", "segment", "start_pos", "end_pos")


@query
def reframe_resets(spark, sf):
    """Every tenth vector of a label resets the frames and holds no samples."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", F.timestamp_seconds("vec_id").alias("ts"), "embedding")
    chunks = signals.with_epoch(vectors.where("vec_id % 10 <> 0"), vectors.where("vec_id % 10 = 0"), "label", "ts")
    frames = signals.reframe(chunks, ["label", "epoch"], "vec_id", "embedding", 24)
    return frames.select("label", "epoch", "frame_no", flat("embedding").alias("samples"))


@query
def speech_captures(spark, sf):
    """Captures by speech start; a sample position counts as a millisecond here."""
    frames = table(spark, sf, "events").withColumn("prob", F.least(F.lit(1.0), F.col("value") / 100))
    found = signals.hysteresis_segments(frames, "user_id", ["ts", "event_id"], "prob", **SPEECH)
    timed = found.withColumns({c: F.timestamp_micros(F.col(c) * 1000) for c in ("start_pos", "end_pos")})
    return utterances.speech_captures(timed, "user_id", "start_pos", "end_pos").select("user_id", "utt_no", "start_us", "end_us", "ended_by")


def _capture_inputs(ev: DataFrame):
    audio = ev.where("event_type IS NULL OR event_type IN ('view', 'purchase')").select(
        "user_id", "ts", F.array(F.col("value").cast("float")).alias("samples")
    )
    return audio, ev.where("event_type = 'click'"), ev.where("event_type = 'purchase'")


@query
def assemble_utterances(spark, sf):
    audio, triggers, ends = _capture_inputs(table(spark, sf, "events"))
    captures = utterances.trigger_captures(audio, triggers, ends, "user_id", timeout=2 * DAY)
    out = utterances.assemble_utterances(audio, captures, "user_id", rate=4, chunk=2)
    return out.select("user_id", "utt_no", "ended_by", flat("samples", 100).alias("samples"))


@query
def assemble_on_timer(spark, sf):
    """Captures that end by themselves after their time, shorter than most pauses between chunks."""
    audio, triggers, ends = _capture_inputs(table(spark, sf, "events"))
    captures = utterances.trigger_captures(audio, triggers, ends, "user_id", timeout=QUIET, timer=True)
    out = utterances.assemble_utterances(audio, captures, "user_id", rate=4, chunk=2)
    return out.select("user_id", "utt_no", "ended_by", flat("samples", 100).alias("samples"))


@query
def while_enabled(spark, sf):
    ev = table(spark, sf, "events")
    turns = ev.where("event_type IN ('signup', 'error')").withColumn("enabled", F.col("event_type") == "signup")
    rows = ev.where("event_type NOT IN ('signup', 'error')").select("user_id", "event_id", "ts")
    return signals.while_enabled(rows, turns, "user_id", "ts").select("user_id", "event_id")


@query
def latest_score(spark, sf):
    ev = timed_events(spark, sf)
    return signals.latest_score(ev, ["user_id", "event_type"], "ts_us", "value")


@query
def replay_states(spark, sf):
    events = timed_events(spark, sf).select("user_id", "event_id", "ts_us", "event_type")
    log = dialogue.replay_states(events, "user_id", "ts_us", "event_type", EVENT_ROLES, tie="event_id")
    return log.select("user_id", "event_id", "event", "state")


ALL_EVENTS = {
    "click0": "trigger", "click1": "enable", "view0": "transcript", "view1": "short_transcript", "purchase0": "answer",
    "purchase1": "done", "signup0": "trigger", "signup1": "done", "error0": "failure", "error1": "disable",
}


@query
def replay_all_events(spark, sf):
    events = timed_events(spark, sf).select(
        "user_id", "event_id", "ts_us", F.concat("event_type", (F.col("event_id") % 2).cast("string")).alias("event_type")
    )
    log = dialogue.replay_states(events, "user_id", "ts_us", "event_type", ALL_EVENTS, tie="event_id")
    return log.select("user_id", "event_id", "event", "state")


@query
def stage_durations(spark, sf):
    ev = timed_events(spark, sf).withColumn("state", F.upper("event_type"))
    limits = {"CLICK": 3600.0, "VIEW": 30000.0}
    timed = dialogue.stage_durations(ev, "user_id", "ts_us", "state", limits, "event_id")
    return timed.select("user_id", "event_id", "state", F.round("seconds", 6).alias("seconds"), "timed_out")


# ---- streams, run to the end of the table

def _run(spark, stream: DataFrame) -> DataFrame:
    base = f"{shared_dir(spark).rstrip('/')}/colloquy/{uuid.uuid4().hex}"
    running = (
        stream.writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _stream_of(spark, df: DataFrame, ts: str) -> DataFrame:
    """The whole table as a stream: all its files in one micro-batch, an end marker in the next."""
    path = f"{shared_dir(spark).rstrip('/')}/colloquy/{uuid.uuid4().hex}"
    spread(df).write.parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    end_marker(spark, df.schema, ts).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files)).parquet(path)


def _event_stream(spark, sf):
    return _stream_of(spark, table(spark, sf, "events").drop("props"), "ts")


@query
def debounce_stream(spark, sf):
    scores = _event_stream(spark, sf).select("user_id", "event_id", "ts", "value")
    out = streams.debounce_stream(scores, "user_id", "ts", "value", 20.0, DAY, "0 seconds", ["event_id"], DAY_MS)
    kept = _run(spark, out)
    return kept.select("user_id", "event_id", micros(kept, "ts").alias("ts_us"))


@query
def replay_stream(spark, sf):
    out = streams.replay_stream(
        _event_stream(spark, sf).drop("value"), "user_id", "ts", "event_type", EVENT_ROLES,
        delay="0 seconds", tie=["event_id"], bucket_ms=DAY_MS,
    )
    return _run(spark, out).select("user_id", "event_id", "event", "state")


@query
def gate_stream(spark, sf):
    clicks = _event_stream(spark, sf).withColumn("busy", F.col("value") * 3600)
    timed = event_time(clicks, "ts", "0 seconds")
    clicks = timed.where(F.when(F.col("ts").isNotNull(), F.col("event_type")) == "click").select(
        "user_id", "event_id", "ts", "busy"
    )
    kept = _run(spark, streams.gate_stream(clicks, "user_id", "ts", "busy", None, ["event_id"], DAY_MS))
    return kept.select("user_id", "event_id", micros(kept, "ts").alias("ts_us"))


@query
def hysteresis_stream(spark, sf):
    frames = _event_stream(spark, sf).select(
        "user_id", "event_id", "ts", F.least(F.lit(1.0), F.col("value") / 100).alias("prob")
    )
    out = streams.hysteresis_stream(frames, "user_id", "ts", "prob", delay="0 seconds", tie=["event_id"], bucket_ms=DAY_MS, **SPEECH)
    return _run(spark, out)


@query
def reframe_stream(spark, sf):
    vectors = table(spark, sf, "embeddings").select("label", F.timestamp_seconds(F.col("vec_id") + 1).alias("ts"), "embedding")
    timed = _stream_of(spark, vectors, "ts")
    frames = _run(spark, streams.reframe_stream(timed, "label", "ts", "embedding", 24, "0 seconds", bucket_ms=60_000))
    return frames.select("label", "frame_no", flat("embedding").alias("samples"))


@query
def while_enabled_stream(spark, sf):
    ev = _event_stream(spark, sf)
    turns = ev.where("event_type IN ('signup', 'error')").select(
        "user_id", "ts", (F.col("event_type") == "signup").alias("enabled")
    )
    rows = ev.where("event_type IS NULL OR event_type NOT IN ('signup', 'error')").select("user_id", "event_id", "ts")
    return _run(spark, streams.while_enabled_stream(rows, turns, "user_id", "ts", delay="0 seconds", bucket_ms=DAY_MS)).select(
        "user_id", "event_id"
    )


@query
def utterance_stream(spark, sf):
    audio, triggers, ends = _capture_inputs(_event_stream(spark, sf))
    out = streams.utterance_stream(
        audio, triggers, ends, "user_id", timeout=2 * DAY, rate=4, chunk=2, delay="0 seconds", bucket_ms=DAY_MS
    )
    return _run(spark, out).select("user_id", "utt_no", "ended_by", flat("samples", 100).alias("samples"))


@query
def utterance_timer_stream(spark, sf):
    """Time runs out by itself: no chunk is needed to end a capture."""
    audio, triggers, ends = _capture_inputs(_event_stream(spark, sf))
    out = streams.utterance_stream(
        audio, triggers, ends, "user_id", timeout=QUIET, rate=4, chunk=2, delay="0 seconds", timer=True, bucket_ms=DAY_MS
    )
    return _run(spark, out).select("user_id", "utt_no", "ended_by", flat("samples", 100).alias("samples"))


@query
def speech_utterance_stream(spark, sf):
    """Every event is a chunk of its value and a frame of the detector."""
    ev = _event_stream(spark, sf).select(
        "user_id", "event_id", "ts", F.least(F.lit(1.0), F.col("value") / 100).alias("prob"), F.array(F.col("value").cast("float")).alias("samples")
    )
    out = streams.speech_utterance_stream(
        ev, "user_id", "ts", "prob", rate=4, chunk=2, delay="0 seconds", tie=["event_id"], bucket_ms=DAY_MS, **SPEECH
    )
    return _run(spark, out).select("user_id", "utt_no", flat("samples", 100).alias("samples"))


@query
def stage_stream(spark, sf):
    ev = _event_stream(spark, sf).select("user_id", "event_id", "ts", F.upper("event_type").alias("state"))
    out = streams.stage_stream(
        ev, "user_id", "ts", "state", {"CLICK": 3600.0, "VIEW": 30000.0}, "0 seconds", ["event_id"], DAY_MS
    )
    return _run(spark, out).select("user_id", "event_id", "state", F.round("seconds", 6).alias("seconds"), "timed_out", "open")


# ---- labelled rows

@query
def sample_splits(spark, sf):
    return labelled.sample_splits(table(spark, sf, "labels"), "quality", SPLITS, "doc_id").select("doc_id", "quality", "split")


@query
def compose_batches(spark, sf):
    return labelled.compose_batches(table(spark, sf, "labels"), "quality", MIX, "doc_id").select(
        "doc_id", "quality", "batch_no"
    )


@query
def label_phrases(spark, sf):
    found = docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    return labelled.label_phrases(found, "w", **PHRASES).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


@query
def smoothed_labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.round(smooth_labels("quality"), 6).alias("quality"))


@query
def fit_clips(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return vectors.select(
        "vec_id", flat(fit_length("embedding", 80)).alias("longer"), flat(fit_length("embedding", 32)).alias("shorter")
    )


@query
def calibrate_threshold(spark, sf):
    scored = table(spark, sf, "events").select(
        F.col("value").alias("score"), (F.col("event_type") == "error").alias("negative")
    )
    return quantiles.calibrate_threshold(scored, 744.0, 0.1)
