"""The queries of this subpackage, by name, and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import compression, jaccard, language, lloyd, mixing, packing, pii, quality_rules, repeats, secrets, spelling, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_pii": pii.op2_pii,
    "op3_substring_dedup": repeats.op3_substring_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mixing_sources": mixing.op5_mixing_sources,
    "op6_compression_classifier": compression.op6_compression_classifier,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_exact_top_k": topk.op9_exact_top_k,
    "op10_ngram_jaccard_join": jaccard.op10_ngram_jaccard_join,
    "op11_centroid_clustering": lloyd.op11_centroid_clustering,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_language_id": language.op13_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": repeats.ORACLE,
    "op5_mixing_sources": mixing.ORACLE,
    "op9_exact_top_k": topk.ORACLE,
    "op10_ngram_jaccard_join": jaccard.ORACLE,
    "op11_centroid_clustering": lloyd.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
}
