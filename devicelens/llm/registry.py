"""The subpackage's queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from devicelens.llm import (decontaminate, fingerprints, hard_negatives, jaccard_join, language_id, line_dedup, packing, pii, quality,
                            quality_rules, token_counts, toxicity, vector_codes)

QUERIES = {
    "op1_harmonic_packing": packing.query,
    "op2_token_group_join": jaccard_join.query,
    "op3_positional_decontamination": decontaminate.query,
    "op4_subword_quality": quality.query,
    "op5_partial_matching_language": language_id.query,
    "op6_site_spread_lines": line_dedup.query,
    "op7_personal_data": pii.query,
    "op8_lexicon_toxicity": toxicity.query,
    "op9_weighted_fingerprints": fingerprints.query,
    "op10_merge_token_counts": token_counts.query,
    "op11_quality_rules": quality_rules.query,
    "op12_pivot_vector_codes": vector_codes.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLE_SQL = {
    "op2_token_group_join": jaccard_join.ORACLE_SQL,
    "op6_site_spread_lines": line_dedup.ORACLE_SQL,
    "op7_personal_data": pii.ORACLE_SQL,
    "op3_positional_decontamination": decontaminate.ORACLE_SQL,
    "op11_quality_rules": quality_rules.ORACLE_SQL,
    "op12_pivot_vector_codes": vector_codes.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
