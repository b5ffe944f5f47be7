"""The registered queries of the training-data operators and their SQL, where SQL can say them."""

from __future__ import annotations

import corpus_pipeline
from ledgerflow.llm import bpe, conversation_repair, exact_dedup, hard_negatives, lm, minhash, mixing, pii, quality, secret_scan, suffix_dedup, token_counts, topk

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_bpe": bpe.op2_bpe,
    "op3_secrets": secret_scan.op3_secrets,
    "op4_quality": quality.op4_quality,
    "op5_minhash": minhash.op5_minhash,
    "op6_mixing": mixing.op6_mixing,
    "op7_lm": lm.op7_lm,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_pii": pii.op10_pii,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_token_counts": token_counts.op13_token_counts,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op1_topk": topk.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
