"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import language, line_dedup, mixing, packing, pii, quality_rules, sharding, simhash, spotsigs, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_spotsigs": spotsigs.op2_spotsigs,
    "op3_language_id": language.op3_language_id,
    "op4_mixing": mixing.op4_mixing,
    "op5_warc": warc.op5_warc,
    "op6_pii": pii.op6_pii,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_sharding": sharding.op8_sharding,
    "op9_packing": packing.op9_packing,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
}

ORACLES = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
}
