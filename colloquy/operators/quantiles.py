"""Exact quantiles and running counts over scores, safe for long groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ordered import RUN_ROWS, arrange


def exact_percentiles(df: DataFrame, key: str, value: str, marks: dict, run_rows: int = RUN_ROWS) -> DataFrame:
    """Linearly interpolated percentiles per key as columns named by ``marks``.

    Values are counted first, so repeated ones collapse before the shuffle; ranks
    are running counts, cut into runs where a key is long.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    ranked = arrange(counted, key, value, run_rows).running_sum("_n", "_cum").result()
    sizes = ranked.groupBy(key).agg(F.max("_cum").alias("_total"))
    placed = ranked.join(sizes, key)
    picks = []
    for name, share in marks.items():
        at = F.lit(float(share)) * (F.col("_total") - 1)
        picks.append(F.min(F.when(F.col("_cum") > F.floor(at), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_cum") > F.ceil(at), F.col(value))).alias(f"_hi_{name}"))
    found = placed.groupBy(key).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for name, share in marks.items():
        at = F.lit(float(share)) * (F.col("_total") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(key, *out)


def calibrate_threshold(
    scored: DataFrame, hours: float, target: float = 0.1, score: str = "score", negative: str = "negative",
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Lowest score whose false positives per hour, counted from the top, stay
    within ``target``: one row (threshold, false_positives)."""
    counted = scored.groupBy(score).agg(F.count_if(F.col(negative)).alias("_fp"))
    counted = counted.withColumn("_down", -F.col(score))
    running = arrange(counted, [], "_down", run_rows).running_sum("_fp", "_cum").result()
    admissible = running.where(F.col("_cum") / F.lit(float(hours)) <= target)
    return admissible.agg(F.min(score).alias("threshold"), F.max("_cum").alias("false_positives"))
