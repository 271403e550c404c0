"""The registered corpus queries and the SQL that checks them."""

from __future__ import annotations

from gigmesh.llm import (
    byte_bpe, chat_format, chunk_dedup, compression_classifier, conversation_repair, conversation_trie, decontaminate, jaccard_join,
    language_id, licence_scan, lm_scoring, quality_rules, url_filter,
)

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_quality_rules": quality_rules.query,
    "op3_chat_format": chat_format.query,
    "op4_chunk_dedup": chunk_dedup.query,
    "op5_url_filter": url_filter.query,
    "op6_compression_classifier": compression_classifier.query,
    "op7_licence_scan": licence_scan.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_decontaminate": decontaminate.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_conversation_trie": conversation_trie.query,
    "op13_lm_scoring": lm_scoring.query,
}

ORACLES: dict[str, str] = {
    "op5_url_filter": url_filter.ORACLE,
    "op7_licence_scan": licence_scan.oracle(),
    "op9_decontaminate": decontaminate.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op12_conversation_trie": conversation_trie.ORACLE,
}
