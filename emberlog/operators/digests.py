"""Cluster digests for a model, packed by a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity, text


def _iso(ts: Column) -> Column:
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def build_digests(ranked: DataFrame, redact: bool = False, seconds: bool = True) -> DataFrame:
    """(source, rank, digest, tokens): a block of text on each ranked cluster and its estimated tokens.

    seconds: times without their fractions.
    """
    mask = text.redact if redact else lambda c: c
    when = (lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")) if seconds else _iso
    window = F.when(F.col("first_seen").isNotNull(), F.concat(F.lit(" | window "), when(F.col("first_seen")), F.lit(" → "), when(F.col("last_seen")))).otherwise("")
    digest = F.concat(
        F.lit("["), F.coalesce(severity.level_name(F.col("level")), F.lit("UNKNOWN")), F.lit(" x"), F.col("count").cast("string"), F.lit("]"), window,
        F.lit("\n  template: "), mask(F.col("template")), F.lit("\n  example:  "), mask(F.col("rep_message")),
    )
    return ranked.select("source", "rank", digest.alias("digest")).withColumn("tokens", text.estimate_tokens(F.col("digest")))


def pack(digests: DataFrame, budget: int) -> DataFrame:
    """Digests with ``batch`` from 0, in rank order: a batch is closed when the next digest would exceed the budget."""
    gathered = digests.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "digest", "tokens"))).alias("d"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + x["tokens"] > budget)
        batch = F.when(full, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(batch.alias("batch"), F.when(full, x["tokens"]).otherwise(acc["used"] + x["tokens"]).alias("used"), F.concat(acc["out"], F.array(batch)).alias("out"))

    batches = F.aggregate("d", start, step, lambda acc: acc["out"])
    return gathered.select("source", F.explode(F.arrays_zip("d", batches.alias("batch"))).alias("r")).select("source", "r.d.*", "r.batch")
