"""Queries and SQL of the corpus operators, as __spark_entry__ registers them."""

from __future__ import annotations

from . import decontam, exact_dedup, html_extract, lm_score, mixing, quality_fm, simhash, substring_dedup, token_output, toxicity_pu

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_template_decontamination": decontam.op4_template_decontamination,
    "op5_html_extraction": html_extract.op5_html_extraction,
    "op6_quality_fm": quality_fm.op6_quality_fm,
    "op7_masked_lm": lm_score.op7_masked_lm,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_toxicity_nnpu": toxicity_pu.op9_toxicity_nnpu,
    "op10_token_output": token_output.op10_token_output,
}
SQL = {"op2_source_mixing": mixing.SQL, "op3_exact_dedup": exact_dedup.SQL}
