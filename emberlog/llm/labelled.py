"""A bounded sample of labelled documents, chosen by id hash, for fitting classifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(remainder: int = 1, modulus: int = 3) -> Column:
    from .common import crc_mod

    return F.coalesce(crc_mod("doc_id", modulus) == remainder, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, target: str, most: dict[int, int]) -> DataFrame:
    """(doc_id, text, label, half) of about ``most[label]`` rows of each label, those of the smallest id hashes.

    Only rows that aren't held out are taken, and ids that several label rows disagree about are left out. The sample's
    ids are few by construction, so they are sent to the documents, not the documents to them. ``half`` is 0 or 1.
    """
    clean = labels.select("doc_id", F.col(target).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(*most) & ~held_out())
    clean = clean.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").select("doc_id", "label")
    sizes = {r["label"]: r["count"] for r in clean.groupBy("label").count().collect()}
    wide = 1 << 30
    share = F.lit(0).cast("long")
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, math.ceil(min(1.0, most[label] / n) * wide)).otherwise(share)
    chosen = clean.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(wide)) < share).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int"))
    return documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", "half")
