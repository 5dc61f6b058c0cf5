"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from retail_insight.llm import (
    decontaminate, fingerprints, hard_negatives, jaccard_join, license_scan, line_dedup, lm_score, quality, secret_scan, source_mix, token_align,
    token_counts, topk_search,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_source_mix": source_mix.op6_source_mix,
    "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op10_lm_scores": lm_score.op10_lm_scores,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op11_token_alignment": token_align.op11_token_alignment,
    "op12_topk_search": topk_search.op12_topk_search,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op4_license_scan": license_scan.oracle(),
    "op12_topk_search": topk_search.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
