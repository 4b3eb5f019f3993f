"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from lexispan.llm import oracle
from lexispan.llm.byte_pairs import op2_byte_pairs
from lexispan.llm.byte_repeats import op1_suffix_dedup
from lexispan.llm.chroma import op7_chroma_alignment
from lexispan.llm.collocations import op13_phrase_collocations
from lexispan.llm.cotraining import op6_quality_classifier
from lexispan.llm.hard_negatives import op11_hard_negatives
from lexispan.llm.mixing import op4_mixing
from lexispan.llm.near_vectors import op12_embedding_dedup
from lexispan.llm.quality_rules import op5_quality_rules
from lexispan.llm.sharding import op8_sharding
from lexispan.llm.simhash import op9_simhash_dedup
from lexispan.llm.substring_dedup import op10_substring_dedup
from lexispan.llm.token_counts import op3_token_counts

_ALL = (
    op1_suffix_dedup, op2_byte_pairs, op3_token_counts, op4_mixing, op5_quality_rules,
    op6_quality_classifier, op7_chroma_alignment, op8_sharding, op9_simhash_dedup, op10_substring_dedup,
    op11_hard_negatives, op12_embedding_dedup, op13_phrase_collocations,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op5_quality_rules": oracle.QUALITY_RULES, "op10_substring_dedup": oracle.SUBSTRING_DEDUP}
