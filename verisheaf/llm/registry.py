"""The queries of this subpackage and, where SQL can express them, the SQL of their rows."""

from __future__ import annotations

from verisheaf.llm import decontamination, exact_dedup, html_text, licenses, mixing, near_dedup, quality, token_counts, token_output, toxicity


def queries() -> dict:
    return {
        "op1_near_duplicates": near_dedup.op1_near_duplicates,
        "op2_token_output": token_output.op2_token_output,
        "op3_quality": quality.op3_quality,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_html_text": html_text.op5_html_text,
        "op6_decontaminate": decontamination.op6_decontaminate,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_mix_sources": mixing.op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontaminate": decontamination.SQL,
        "op7_exact_dedup": exact_dedup.SQL,
        "op9_license_scan": licenses.sql(),
        "op10_mix_sources": mixing.SQL,
    }
