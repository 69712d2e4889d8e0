"""Queries of the training-data operators and, where SQL can express one, its oracle."""

from __future__ import annotations

from . import exact_dedup, html_layout, language_id, ngram_join, packing, projection_forest, sentencepiece_fst, sharding, substring_dedup, token_counts

QUERIES = {
    "op1_sentencepiece_fst": sentencepiece_fst.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_token_counts": token_counts.query,
    "op4_embedding_near_dedup": projection_forest.query,
    "op5_language_id": language_id.query,
    "op6_ngram_join": ngram_join.query,
    "op7_packing": packing.query,
    "op8_html_layout": html_layout.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_sharding": sharding.query,
}

ORACLES = {"op2_exact_dedup": exact_dedup.ORACLE}
