"""Column functions over numbers, sample arrays and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The largest sample of each format, sample rate, chunk length,
# the shortest capture that is transcribed, label smoothing.
PCM_PEAK = {"int32": 2147483647.0, "int16": 32767.0, "int8": 127.0, "uint8": 255.0}
SAMPLE_RATE = 16000
AUDIO_CHUNK = 1280
MIN_SAMPLES = 1600
LABEL_SMOOTHING = 0.05


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970 for both timestamp types, numbers as they are.

    Zone-less timestamps are read as UTC whatever the session zone is.
    """
    kind = df.schema[col].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(col))
    return F.col(col).cast("bigint")


def cosine_distance(a, b) -> Column:
    """``1 - cosine``; null if either vector has no length."""
    def dot(x, y):
        products = F.zip_with(_col(x), _col(y), lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1 - F.try_divide(dot(a, b), norms)


def pcm_to_float(col, fmt) -> Column:
    """Integer samples as floats; null for a format that is not supported.

    float32 passes through. uint8 is not centred, so it lands in 0..1.
    """
    samples = _col(col)
    fmt = _col(fmt)
    peak = F.lit(None).cast("double")
    for name, value in PCM_PEAK.items():
        peak = F.when(fmt == name, F.lit(value)).otherwise(peak)
    scaled = F.transform(samples, lambda x: (x.cast("double") / peak).cast("float"))
    return F.when(fmt == "float32", samples.cast("array<float>")).when(fmt.isin(list(PCM_PEAK)), scaled)


def float_to_pcm16(col) -> Column:
    """Clip to -1..1, scale by 32767 and cut towards zero."""
    return F.transform(
        _col(col),
        lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("smallint"),
    )


def audio_seconds(col, rate: int = SAMPLE_RATE) -> Column:
    return F.size(_col(col)) / F.lit(float(rate))


def too_short(col, min_samples: int = MIN_SAMPLES) -> Column:
    return F.size(_col(col)) < min_samples


def pad_short(col, rate=SAMPLE_RATE, chunk=AUDIO_CHUNK) -> Column:
    """A capture under one second is filled with zeros up to ``chunk + rate``."""
    samples = _col(col)
    rate = F.lit(rate) if isinstance(rate, int) else _col(rate)
    chunk = F.lit(chunk) if isinstance(chunk, int) else _col(chunk)
    missing = F.greatest(F.lit(0), chunk + rate - F.size(samples)).cast("int")
    padded = F.concat(samples, F.array_repeat(F.lit(0.0).cast("float"), missing))
    return F.when((rate > 0) & (F.size(samples) < rate), padded).otherwise(samples)


def fit_length(col, n: int) -> Column:
    """Crop or zero-pad an array to exactly ``n`` samples."""
    samples = _col(col)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(n) - F.size(samples)))
    return F.slice(F.concat(samples, zeros), 1, n)


def smooth_labels(col, eps: float = LABEL_SMOOTHING) -> Column:
    """0 becomes ``eps`` and 1 becomes ``1 - eps``."""
    return _col(col) * (1 - 2 * eps) + eps


def format_ticks(col, comma: bool = False) -> Column:
    """Ticks of 10 ms as ``HH:MM:SS.mmm``."""
    ms = _col(col).cast("bigint") * 10

    def part(unit, size):
        return (F.floor(ms / unit) % size).cast("bigint")

    sep = "," if comma else "."
    hours = F.floor(ms / 3600000).cast("bigint")
    return F.format_string(
        f"%02d:%02d:%02d{sep}%03d", hours, part(60000, 60), part(1000, 60), (ms % 1000).cast("bigint")
    )
