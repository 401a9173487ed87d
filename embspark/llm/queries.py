"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from embspark.llm.byte_repeats import op6_suffix_array
from embspark.llm.fingerprints import op10_fingerprints
from embspark.llm.lm_scoring import op8_lm_scoring
from embspark.llm.packing import op4_packing
from embspark.llm.quality import op2_quality_rules
from embspark.llm.sentencepieces import op3_sentencepiece
from embspark.llm.sharding import op9_sharding
from embspark.llm.simhash import op1_simhash
from embspark.llm.token_counts import op7_token_counts
from embspark.llm.word_repeats import op5_substring_dedup

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_packing": op4_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_suffix_array": op6_suffix_array,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_sharding": op9_sharding,
    "op10_fingerprints": op10_fingerprints,
}

# Tokenizers, suffix structures, fingerprints over shingles and random draws have no SQL; their tests compare with brute force.
SQL: dict[str, str] = {}
