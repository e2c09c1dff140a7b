"""Preparing labelled phrases and clips, as asked for by a wakeword configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import clean_text
from colloquy.operators.ordered import RUN_ROWS, arrange

# Rows per class and split, rows per class in a batch, phrases.
SPLIT_COUNTS = {
    "phrase": {"train": 25000, "validation": 5000},
    "background": {"train": 2000, "validation": 500},
}
BATCH_MIX = {"positive": 50, "adversarial_negative": 50, "speech": 1024, "background_noise": 50}
TARGETS = ["hey robot", "hello robot", "good morning robot"]
NEGATIVES = ["robot", "roboter", "hello", "hey", "hi", "hey there", "good morning"]


def _by_class(df: DataFrame, class_col: str, id: str, seed: int, run_rows: int) -> DataFrame:
    """Number the rows of a class in the order of a hash of their id."""
    mixed = df.withColumn("_mix", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string"))))
    return arrange(mixed, class_col, ["_mix", id], run_rows).running_sum(F.lit(1), "_no").result().drop("_mix")


def sample_splits(df: DataFrame, class_col: str, counts: dict, id: str, seed: int = 0, run_rows: int = RUN_ROWS) -> DataFrame:
    """Fixed numbers of rows per class and split.

    ``counts`` maps a class to ``{split: rows}``; splits follow each other in a
    hash order of the ids, so they do not depend on how rows are stored.
    """
    split = F.lit(None).cast("string")
    for name, sizes in counts.items():
        low = 0
        for part, rows in sizes.items():
            inside = (F.col(class_col) == name) & (F.col("_no") > low) & (F.col("_no") <= low + rows)
            split = F.when(inside, F.lit(part)).otherwise(split)
            low += rows
    return _by_class(df, class_col, id, seed, run_rows).withColumn("split", split).where("split IS NOT NULL").drop("_no")


def compose_batches(df: DataFrame, class_col: str, per_batch: dict, id: str, seed: int = 0, run_rows: int = RUN_ROWS) -> DataFrame:
    """Batches with a fixed number of rows of each class; only full ones are kept."""
    sizes = {r[0]: r[1] for r in df.where(F.col(class_col).isin(list(per_batch))).groupBy(class_col).count().collect()}
    full = min(sizes.get(name, 0) // n for name, n in per_batch.items())
    share = F.create_map(*[F.lit(x) for pair in per_batch.items() for x in pair])
    numbered = _by_class(df, class_col, id, seed, run_rows)
    batch = F.floor((F.col("_no") - 1) / F.try_element_at(share, F.col(class_col))).cast("bigint")
    return numbered.withColumn("batch_no", batch).where(F.col("batch_no") < full).drop("_no")


def label_phrases(df: DataFrame, text: str, targets=TARGETS, negatives=NEGATIVES) -> DataFrame:
    """Add ``label``: positive, adversarial or background, by the cleaned phrase."""
    phrase = clean_text(text)
    label = F.when(phrase.isin(*[t.lower() for t in targets]), "positive").when(
        phrase.isin(*[n.lower() for n in negatives]), "adversarial"
    )
    return df.withColumn("label", label.otherwise("background"))
