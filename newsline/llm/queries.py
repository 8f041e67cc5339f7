"""Queries and SQL of this subpackage, one query per operator."""

from __future__ import annotations

from newsline.llm import bpe, chat_format, decontaminate, embedding_dedup, filter_audit, hard_negatives, html_text, jaccard_join, language_id, line_dedup, mixing, substring_dedup, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_ngram_jaccard": jaccard_join.op4_ngram_jaccard,
    "op5_html_text": html_text.op5_html_text,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_language_id": language_id.op7_language_id,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_source_mix": mixing.op13_source_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE_SQL,
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op3_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op4_ngram_jaccard": jaccard_join.ORACLE_SQL,
    "op6_chat_format": chat_format.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_source_mix": mixing.ORACLE_SQL,
}
