"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import benchmark_decontamination, chat_format, embedding_dedup, language_id, minhash_dedup, packing, quality_classifier, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_embedding_near_dedup": embedding_dedup.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_benchmark_decontamination": benchmark_decontamination.query,
    "op6_chat_formatting": chat_format.query,
    "op7_packing": packing.query,
    "op8_url_filter": url_filter.query,
    "op9_minhash_near_dedup": minhash_dedup.query,
    "op10_language_id": language_id.query,
}
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_near_dedup": embedding_dedup.SQL,
    "op5_benchmark_decontamination": benchmark_decontamination.SQL,
    "op6_chat_formatting": chat_format.SQL,
    "op9_minhash_near_dedup": minhash_dedup.SQL,
}
