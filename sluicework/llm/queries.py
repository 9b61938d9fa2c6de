"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_formatting, decontamination, hard_negatives, line_dedup, lm_scoring, merkle_manifest, packing, quality_classifier, quality_rules, simhash_dedup, suffix_dedup, token_counts, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
    "op7_packing": packing.op7_packing,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_chat_formatting": chat_formatting.op9_chat_formatting,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_token_counts": token_counts.op13_token_counts,
}
ORACLE_SQL = {"op1_url_filters": url_filters.OP1_SQL, "op9_chat_formatting": chat_formatting.OP9_SQL, "op10_line_dedup": line_dedup.OP10_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
