"""URL verdicts from rules, by hashed host-suffix and path-prefix expressions.

Every URL is expanded into (host suffix, path prefix up to a slash) expressions, as deep as some rule is. They
meet the rules on a short prefix of their digest; the full digest and the rule's path confirm a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.runtime import BROADCAST_ROWS, within

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 8   # hex digits of the digest that the join uses
SALTS = 32   # copies of each rule when the rules are too many to broadcast


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(rest, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _folder(path: Column) -> Column:
    """A path up to and with its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Columns of ``pages`` with host, path, rule and verdict; columns of those names are replaced.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule fits its host and all subdomains if the
    URL's path starts with its path. The longest host and path together win; among equally long ones the longer
    host, then a block. A URL without a rule has a null rule and the ``default`` verdict. Null URLs have an empty
    host and path. Repeated rows are judged alike; rules with a null host or path are ignored; empty tables of
    either kind are fine.

    Distinct (host, path) pairs are judged once. Rules are broadcast behind a count; more of them meet the
    expressions on salted keys. Expressions go as deep as the deepest rule, so a URL's count of slashes or
    labels does not matter.
    """
    rules = rules.where("host is not null and path is not null").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"),
        F.concat(F.translate("host", UPPER, LOWER), "path").alias("rule"),
    )
    rules = rules.withColumn("full", _digest(F.col("rule_host"), _folder(F.col("rule_path")))).withColumn("short", F.substring("full", 1, PREFIX))
    depth = rules.agg(
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1)),
        F.coalesce(F.max(F.length("rule_path") - F.length(F.replace("rule_path", F.lit("/"), F.lit("")))), F.lit(0)),
    ).first()
    placed = pages.drop("host", "path", "rule", "verdict").withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))

    labels = F.split("host", r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth[0]))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    folders = F.slice(F.split("path", "/", -1), 1, depth[1] + 1)  # what precedes each of the first slashes
    cuts = F.least(F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))), F.lit(depth[1]))
    paths = F.transform(F.sequence(F.lit(0), cuts), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(folders, F.lit(1), n), "/"), F.lit("/"))))
    distinct = placed.select("host", "path").distinct()
    expressions = (
        distinct.withColumn("suffix", F.explode(hosts)).withColumn("prefix", F.explode(paths))
        .withColumn("full_key", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("full_key", 1, PREFIX))
        .select("host", "path", "full_key", "short")
    )
    if within(rules, BROADCAST_ROWS):
        met = expressions.join(F.broadcast(rules), "short")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expressions.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    fits = met.where((F.col("full_key") == F.col("full")) & F.startswith("path", "rule_path"))
    order = F.struct(F.length("rule"), F.length("rule_host"), F.when(F.col("rule_verdict") == "block", 1).otherwise(0), F.col("rule"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("best"))
    return placed.join(best, ["host", "path"], "left").select(
        *[c for c in placed.columns], F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )
