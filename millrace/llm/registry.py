"""Queries of the training-data operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from millrace.llm import chat, digest, mixing, packing, pii, recompression, scoring, search, simhash, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_packing": packing.op2_packing,
    "op3_pii": pii.op3_pii,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_digest": digest.op5_digest,
    "op6_search": search.op6_search,
    "op7_chat": chat.op7_chat,
    "op8_simhash": simhash.op8_simhash,
    "op9_scoring": scoring.op9_scoring,
    "op10_recompression": recompression.op10_recompression,
    "pii_base_counts": pii.pii_base_counts,
}
ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op6_search": search.OP6_SQL,
    "op7_chat": chat.OP7_SQL,
    "op9_scoring": scoring.OP9_SQL,
    "op10_recompression": recompression.OP10_SQL,
    "pii_base_counts": pii.BASE_COUNTS_SQL,
}
