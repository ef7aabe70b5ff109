"""Queries and SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from recordkeep.llm import decontam, html_text, language_id, line_dedup, merkle, packing, quality, repeats, simhash, spelling, token_counts, topk, toxicity


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_decontamination": decontam.op2_decontamination,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_exact_topk": topk.op5_exact_topk,
        "op6_suffix_array_dedup": repeats.op6_suffix_array_dedup,
        "op7_simhash_dedup": simhash.op7_simhash_dedup,
        "op8_html_text": html_text.op8_html_text,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_language_id": language_id.op10_language_id,
        "op11_quality": quality.op11_quality,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op5_exact_topk": topk.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_spelling_variants": spelling.ORACLE}
