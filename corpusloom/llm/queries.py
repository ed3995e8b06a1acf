"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from corpusloom.llm.byte_bpe import op8_byte_bpe
from corpusloom.llm.hamming import OP1_SQL, op1_multi_index_hamming
from corpusloom.llm.hard_negatives import OP13_SQL, op13_threshold_hard_negatives
from corpusloom.llm.importance import OP12_SQL, op12_importance_resampling
from corpusloom.llm.licences import op3_licence_scan
from corpusloom.llm.minhash import op9_minhash_near_dedup
from corpusloom.llm.packing import op2_sum_of_squares_packing
from corpusloom.llm.pii import op4_pii
from corpusloom.llm.quality import op10_cotraining_quality
from corpusloom.llm.rpforest import op5_rp_forest_near_dedup
from corpusloom.llm.substring import op7_substring_dedup
from corpusloom.llm.token_counts import op11_whole_token_counts
from corpusloom.llm.urls import op6_url_association_rules

QUERIES = {
    "op1_multi_index_hamming": op1_multi_index_hamming,
    "op2_sum_of_squares_packing": op2_sum_of_squares_packing,
    "op3_licence_scan": op3_licence_scan,
    "op4_pii": op4_pii,
    "op5_rp_forest_near_dedup": op5_rp_forest_near_dedup,
    "op6_url_association_rules": op6_url_association_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_cotraining_quality": op10_cotraining_quality,
    "op11_whole_token_counts": op11_whole_token_counts,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_threshold_hard_negatives": op13_threshold_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_multi_index_hamming": OP1_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_threshold_hard_negatives": OP13_SQL,
}
