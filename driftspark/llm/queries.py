"""The operators' queries and, where SQL can say them, their oracles."""

from __future__ import annotations

from driftspark.llm import decontamination, embedding_dedup, hard_negatives, language_id, license_scan, lm_scoring, mixing, near_dedup, quality_rules, sharding, token_alignment, token_counts, toxicity

_QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_language_id": language_id.op5_language_id,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_sharding": sharding.op10_sharding,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
_SQL = {"op9_license_scan": license_scan.SQL, "op2_embedding_dedup": embedding_dedup.SQL, "op4_decontamination": decontamination.SQL, "op7_near_dedup": near_dedup.SQL, "op11_quality_rules": quality_rules.SQL, "op13_hard_negatives": hard_negatives.SQL}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)
