"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last return the
columns they were given:

1. quality classifier: documents that score below 0.5 go;
2. MinHash near-dedup: of each group of near duplicates the document of the smallest doc_id stays;
3. substring dedup: copied passages are cut out of the texts; documents of which nothing is left go;
4. benchmark decontamination: documents that contain a window of a benchmark item go;
5. packing: the rest becomes pieces of training sequences.

Nulls, empty texts, repeated rows and extra columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import benchmark_decontamination, minhash_dedup, packing, quality_classifier, substring_dedup
from emberlog.llm.common import read, stored


def _plain(docs: DataFrame) -> DataFrame:
    """The documents with names that no operator uses, but for doc_id and text."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"__c{i}") for i, c in enumerate(docs.columns)])


def _named(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The result's columns under the documents' names."""
    return result.select(*[F.col(c if c in ("doc_id", "text") else f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is trained on the labelled documents among ``docs``."""
    plain = _plain(docs)
    model = quality_classifier.train(plain, read(spark, sf_dir, "labels"))
    return _named(quality_classifier.score_quality(plain, model).where("score >= 0.5"), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _named(minhash_dedup.keep_one(_plain(docs)), docs)


def cut_copied_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_copies(_plain(docs))
    return _named(cut.where((F.col("n_removed") == 0) | (F.trim("text") != "")), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = benchmark_decontamination.benchmark_hits(_plain(docs), read(spark, sf_dir, "benchmark"))
    return _named(found.where("n_hit = 0"), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_plain(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("substring_dedup", cut_copied_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL expresses neither the learned classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
