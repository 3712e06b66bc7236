"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from lexiloom.llm import embedding_dedup, exact_dedup, jaccard_join, language_id, lexical_search, merkle, packing, quality, secret_scan, sentence_pieces, source_mix, suffix_dedup, toxicity

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_sentence_pieces": sentence_pieces.op3_sentence_pieces,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_source_mix": source_mix.op6_source_mix,
    "op7_quality": quality.op7_quality,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_language_id": language_id.op9_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_best_fit_packing": packing.op13_best_fit_packing,
}

ORACLE_SQL = {
    "op1_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_secret_scan": secret_scan.ORACLE_SQL,
    "op6_source_mix": source_mix.ORACLE_SQL,
    "op8_jaccard_join": jaccard_join.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_lexical_search": lexical_search.ORACLE_SQL,
}
