"""The text operators' queries and SQL."""

from __future__ import annotations

from . import best_fit, chat_format, decontaminate, jaccard_join, lm_score, quality_rules, substring_dedup, token_counts, url_filter, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_lm_score": lm_score.op2_lm_score,
    "op5_url_filter": url_filter.op5_url_filter,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op6_best_fit_packing": best_fit.op6_best_fit_packing,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_warc": warc.op9_warc,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
}
