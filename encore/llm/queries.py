"""The operators of this subpackage as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from encore.llm import (
    bpe,
    exact_dedup,
    hard_negatives,
    langid,
    lexical,
    neighbours,
    packing,
    pii,
    secret_scan,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_nearest_neighbours": neighbours.op2_nearest_neighbours,
    "op3_bpe_encode_decode": bpe.op3_bpe_encode_decode,
    "op4_packing": packing.op4_packing,
    "op5_pii": pii.op5_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language_id": langid.op7_language_id,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_lexical_search": lexical.op13_lexical_search,
}

SQL = {
    "op2_nearest_neighbours": neighbours.OP2_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}
