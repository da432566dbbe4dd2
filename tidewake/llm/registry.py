"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from tidewake.llm import bpe, chat, exact_dedup, filter_audit, line_dedup, merkle, mixing, quality, simhash, span_dedup, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_token_counts": bpe.op8_token_counts,
    "op9_span_dedup": span_dedup.op9_span_dedup,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_toxicity": toxicity.op13_toxicity,
}
ORACLES = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op9_span_dedup": span_dedup.OP9_SQL,
    "op10_exact_topk": topk.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
