"""The queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from . import exact_search, line_dedup, mixing, ngram_join, ngram_lm, piece_sampling, quality, secrets, spelling, substring_dedup, token_counts, toxicity, vector_codes

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_ngram_jaccard": ngram_join.op3_ngram_jaccard,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_exact_topk": exact_search.op6_exact_topk,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_piece_sampling": piece_sampling.op9_piece_sampling,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_ngram_lm": ngram_lm.op12_ngram_lm,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL = {
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op6_exact_topk": exact_search.ORACLE_SQL,
    "op10_mix_sources": mixing.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
}
