"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, html_crf, jaccard_join, line_dedup, lm, passages, pieces, quality, topk

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_exact_topk": topk.op3_exact_topk,
    "op4_lm_scoring": lm.op4_lm_scoring,
    "op5_html_extraction": html_crf.op5_html_extraction,
    "op6_substring_dedup": passages.op6_substring_dedup,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_ngram_jaccard_join": jaccard_join.op8_ngram_jaccard_join,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_quality_classifier": quality.op10_quality_classifier,
}

ORACLES = {
    "op1_benchmark_decontamination": decontaminate.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_exact_topk": topk.ORACLE,
    "op8_ngram_jaccard_join": jaccard_join.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
}
