"""The queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .class_lm import op5_lm_scoring
from .decontamination import op4_benchmark_decontamination
from .filter_audit import OP11_SQL, op11_filter_interaction_audit
from .fingerprints import op3_document_fingerprints
from .language_id import op9_language_id
from .near_dedup import op1_minhash_near_dedup
from .packing import op6_best_fit_packing
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .substring_dedup import OP7_SQL, op7_substring_dedup
from .suffix_dedup import OP12_SQL, op12_suffix_array_dedup
from .token_counts import op2_token_counts
from .toxicity import op8_toxicity
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_filter_interaction_audit": op11_filter_interaction_audit,
    "op12_suffix_array_dedup": op12_suffix_array_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op7_substring_dedup": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op11_filter_interaction_audit": OP11_SQL,
    "op12_suffix_array_dedup": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
