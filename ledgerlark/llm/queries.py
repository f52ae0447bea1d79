"""The numbered queries and their SQL, for the entry module."""

from __future__ import annotations

from . import chat_format, decontamination, exact_dedup, html_extract, lm_scoring, near_dedup, packing, repair, resampling, sharding, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
    "op2_decontaminate": decontamination.op2_decontaminate,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_shard": sharding.op5_shard,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_pack": packing.op9_pack,
    "op10_lm_score": lm_scoring.op10_lm_score,
    "op11_resample": resampling.op11_resample,
    "op12_repair": repair.op12_repair,
    "op13_chat_format": chat_format.op13_chat_format,
}

ORACLES = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_resample": resampling.OP11_SQL,
    "op12_repair": repair.OP12_SQL,
    "op13_chat_format": chat_format.OP13_SQL,
}
