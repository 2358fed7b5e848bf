"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_format, mixing, packing, quality_model, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, topk

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_quality_classifier": quality_model.op5_quality_classifier,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_topk": topk.op9_topk,
    "op10_sharding": sharding.op10_sharding,
}

SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op9_topk": topk.OP9_SQL,
    "op10_sharding": sharding.OP10_SQL,
}
