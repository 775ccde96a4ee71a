"""Queries and SQL of the operators of this subpackage."""

from __future__ import annotations

from linkloom.llm import (
    byte_bpe, dart_minhash, decontamination, hard_negatives, host_reputation, language, mixing, passages, periodic_runs, personal_data, quality, toxicity, vectors,
)

QUERIES = {
    "op1_entropy_mix": mixing.op1_entropy_mix,
    "op2_host_reputation": host_reputation.op2_host_reputation,
    "op3_rank_order_language": language.op3_rank_order_language,
    "op4_ordinal_toxicity": toxicity.op4_ordinal_toxicity,
    "op5_multi_index": vectors.op5_multi_index,
    "op6_quality_qda": quality.op6_quality_qda,
    "op7_template_leaks": decontamination.op7_template_leaks,
    "op8_dart_minhash": dart_minhash.op8_dart_minhash,
    "op9_phrase_automata": passages.op9_phrase_automata,
    "op10_weak_supervision": personal_data.op10_weak_supervision,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_anchor_tree_negatives": hard_negatives.op13_anchor_tree_negatives,
}

ORACLE_SQL = {
    "op2_host_reputation": host_reputation.ORACLE_SQL,
    "op5_multi_index": vectors.ORACLE_SQL,
    "op8_dart_minhash": dart_minhash.ORACLE_SQL,
    "op9_phrase_automata": passages.ORACLE_SQL,
    "op13_anchor_tree_negatives": hard_negatives.ORACLE_SQL,
}
