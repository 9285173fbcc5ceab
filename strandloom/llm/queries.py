"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import audit, bpe, debruijn, decontaminate, lines, lm, pieces_bpe, resample, sharding, simhash, suffix, topk, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_bpe": bpe.op2_bpe,
    "op3_topk": topk.op3_topk,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_lines": lines.op5_lines,
    "op6_debruijn": debruijn.op6_debruijn,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_simhash": simhash.op8_simhash,
    "op9_suffix": suffix.op9_suffix,
    "op10_lm": lm.op10_lm,
    "op11_resample": resample.op11_resample,
    "op12_audit": audit.op12_audit,
    "op13_sentencepiece": pieces_bpe.op13_sentencepiece,
}
#: DuckDB SQL for the queries that SQL can express within reason.
ORACLE_SQL: dict[str, str] = {"op3_topk": topk.OP3_SQL, "op6_debruijn": debruijn.OP6_SQL, "op11_resample": resample.OP11_SQL, "op12_audit": audit.OP12_SQL}
