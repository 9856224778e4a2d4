"""The corpus operators' queries and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from basalt.llm import embedding_dedup, language_id, mixing, packing, quality_classifier, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, url_filter

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_quality_rules": quality_rules.query,
    "op3_url_filter": url_filter.query,
    "op4_embedding_dedup": embedding_dedup.query,
    "op5_simhash_dedup": simhash_dedup.query,
    "op6_language_id": language_id.query,
    "op7_quality_classifier": quality_classifier.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_mixing": mixing.query,
    "op10_suffix_dedup": suffix_dedup.query,
}
ORACLE_SQL = {"op4_embedding_dedup": embedding_dedup.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL}
