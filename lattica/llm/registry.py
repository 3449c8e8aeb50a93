"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from lattica.llm import decontaminate, licenses, linededup, lm_score, packing, quality, secrets, sharding, simhash, topk

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_licenses": licenses.op2_licenses,
    "op3_simhash": simhash.op3_simhash,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_shard": sharding.op5_shard,
    "op6_pack": packing.op6_pack,
    "op7_quality": quality.op7_quality,
    "op8_secrets": secrets.op8_secrets,
    "op9_topk": topk.op9_topk,
    "op10_lm_score": lm_score.op10_lm_score,
}
ORACLE_SQL = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op8_secrets": secrets.ORACLE,
    "op9_topk": topk.ORACLE,
}
