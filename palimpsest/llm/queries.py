"""The subpackage's queries and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from . import ball_kmeans, byte_cnn, chat, decontaminate, fm_classifier, lexical_search, mixing, ngram_join, oracles, pii, quality_rules, recompression, suffix_dedup, token_store

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.query,
    "op2_mixing_sources": mixing.query,
    "op3_quality_rules": quality_rules.query,
    "op4_quality_classifier": fm_classifier.query,
    "op5_substring_dedup": recompression.query,
    "op6_decontamination": decontaminate.query,
    "op7_ngram_jaccard_join": ngram_join.query,
    "op8_token_store": token_store.query,
    "op9_chat_formatting": chat.query,
    "op10_pii": pii.query,
    "op11_lexical_search": lexical_search.query,
    "op12_ball_kmeans": ball_kmeans.query,
    "op13_byte_cnn": byte_cnn.query,
}

SQL: dict[str, str] = {
    "op3_quality_rules": oracles.QUALITY_RULES,
    "op5_substring_dedup": oracles.SUBSTRINGS,
    "op6_decontamination": decontaminate.SQL,
    "op7_ngram_jaccard_join": oracles.JOIN,
    "op9_chat_formatting": chat.SQL,
    "op11_lexical_search": lexical_search.SQL,
    "op12_ball_kmeans": ball_kmeans.SQL,
}
