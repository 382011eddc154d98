"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bit_sliced, bpe, exact_dedup, jaccard_join, language_id, license_scan, lm_scoring, near_vectors, packing, prefix_trie, quality, substring_dedup, vector_codes

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_packing": packing.op2_packing,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_top_k": bit_sliced.op7_top_k,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_language_id": language_id.op10_language_id,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_near_vectors": near_vectors.op13_near_vectors,
}

ORACLE_SQL = {
    "op3_lm_scoring": lm_scoring.OP3_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_top_k": bit_sliced.OP7_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_near_vectors": near_vectors.OP13_SQL,
}
