"""Literal edge cases of the column functions and small operators."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import (
    audio_seconds, clean_text, cosine_distance, fit_length, float_to_pcm16, format_ticks, lstrip_set, min_length,
    pad_short, pcm_to_float, regex_trim, smooth_labels, too_short,
)
from colloquy.operators.documents import append_tables, scalar_metadata
from colloquy.operators.prompts import PERSONALITY, build_prompt, direct_prompts
from colloquy.sources.files import drop_comments


def one(spark, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not hasattr(v, "alias") else v.alias(k) for k, v in cols.items()])
    return df.first()


def test_text(spark):
    row = one(
        spark, a=clean_text(F.lit("\t Hello THERE \n")), b=lstrip_set(F.lit(" ,!. ?so, yes")),
        c=regex_trim(F.lit("\r\n a b \t")), d=min_length(F.lit(" 123456789 ")), e=min_length(F.lit("1234567890")),
    )
    assert row == ("hello there", "so, yes", "a b", False, True)


def test_ticks(spark):
    row = one(
        spark, a=format_ticks(F.lit(366123)), b=format_ticks(F.lit(366123), comma=True), c=format_ticks(F.lit(0)),
        d=format_ticks(F.lit(36000000)),
    )
    assert row == ("01:01:01.230", "01:01:01,230", "00:00:00.000", "100:00:00.000")


def test_comments(spark):
    lines = ["# no", "   # no", "", "   ", " model:1b ", "a # b"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.value for r in drop_comments(df, "value").collect()] == ["model:1b", "a # b"]


def test_pcm(spark):
    df = spark.createDataFrame(
        [("uint8", [0, 255]), ("int8", [-128, 127]), ("int16", [-32767, 32767]), ("int32", [2147483647]), ("int24", [1])],
        "fmt string, raw array<bigint>",
    )
    out = {r.fmt: r.s for r in df.select("fmt", pcm_to_float("raw", "fmt").alias("s")).collect()}
    assert out["uint8"] == [0.0, 1.0] and out["int16"] == [-1.0, 1.0] and out["int32"] == [1.0] and out["int24"] is None
    assert out["int8"][0] < -1 and out["int8"][1] == 1.0


def test_pcm16_clips_and_truncates(spark):
    row = one(spark, s=float_to_pcm16(F.array(*[F.lit(x) for x in (2.0, -3.0, 0.5, -0.5, 0.99999)])))
    assert row.s == [32767, -32767, 16383, -16383, 32766]


def test_round_trip_is_close(spark):
    xs = [i / 97 - 1 for i in range(195)]
    df = spark.createDataFrame([(xs,)], "x array<double>")
    back = df.select(pcm_to_float(float_to_pcm16("x"), F.lit("int16")).alias("y")).first().y
    assert max(abs(a - max(-1, min(1, b))) for a, b in zip(back, xs)) <= 1 / 32767 + 1e-7


def test_capture_lengths(spark):
    zeros = lambda n: F.array_repeat(F.lit(0.5).cast("float"), n)
    row = one(
        spark, a=F.size(pad_short(zeros(8000))), b=F.size(pad_short(zeros(16000))), c=too_short(zeros(1599)),
        d=too_short(zeros(1600)), e=audio_seconds(zeros(8000)), f=F.size(fit_length(zeros(3), 5)),
        g=F.size(fit_length(zeros(9), 5)), h=smooth_labels(F.lit(1)), i=smooth_labels(F.lit(0)),
    )
    assert row[:7] == (17280, 16000, True, False, 0.5, 5, 5)
    assert row.h == pytest.approx(0.95) and row.i == pytest.approx(0.05)


def test_cosine(spark):
    vec = lambda *x: F.array(*[F.lit(v) for v in x])
    row = one(spark, a=cosine_distance(vec(1.0, 0.0), vec(0.0, 2.0)), b=cosine_distance(vec(1.0), vec(3.0)),
              c=cosine_distance(vec(0.0, 0.0), vec(1.0, 0.0)))
    assert row == (1.0, 0.0, None)


def test_metadata(spark):
    raw = '{"a": 1, "b": [1], "c": {"x": 1}, "d": true, "e": null, "f": 1.5, "g": "s"}'
    df = spark.createDataFrame([(raw,), (None,)], "j string")
    got = [r.metadata for r in scalar_metadata(df, "j").collect()]
    assert got == [{"a": "1", "d": "true", "e": None, "f": "1.5", "g": "s"}, None]


def test_tables(spark):
    rows = [
        (1, "t", [{"detailed_content": "x"}, {"detailed_content": ""}, {"detailed_content": None}, {"detailed_content": "y"}]),
        (2, "t", [{"detailed_content": ""}]), (3, "t", None),
    ]
    df = spark.createDataFrame(rows, "id int, text string, tables array<struct<detailed_content:string>>")
    got = {r.id: r.text for r in append_tables(df).collect()}
    assert got[1] == "t\n\n--- TABLE CONTENT ---\n\nx\n\ny\n\n--- END TABLE CONTENT ---"
    assert got[2] == "t" and got[3] == "t"


def test_prompts(spark):
    df = spark.createDataFrame([(1, "q?", None), (2, "q?", ""), (3, "q?", "c")], "query_id int, query string, context string")
    got = [r.prompt for r in build_prompt(df, "Be kind.", "Use it.").orderBy("query_id").collect()]
    assert got == ["Be kind.\nQuery: q?", "Be kind.\nQuery: q?", "c\n\nBe kind. Use it.\nQuery: q?"]
    assert direct_prompts(df.select("query_id", "query")).first().prompt == f"{PERSONALITY}\nQuery: q?"
