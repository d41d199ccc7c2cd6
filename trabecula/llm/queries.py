"""Queries of the operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trabecula.llm.block_naming import op4_block_naming
from trabecula.llm.chat import OP6_SQL, op6_typed_parts
from trabecula.llm.collocations import OP13_SQL, op13_fm_index
from trabecula.llm.decontamination import op10_qgram_bands
from trabecula.llm.licences import OP8_SQL, op8_sentence_rules
from trabecula.llm.packing import op2_best_fit_packing
from trabecula.llm.pii import op1_skip_chain_crf
from trabecula.llm.prefix_trie import OP11_SQL, op11_depth_bands
from trabecula.llm.repeats import op12_bucket_pointers
from trabecula.llm.sharding import op7_virtual_slots
from trabecula.llm.simhash import op5_simhash_pigeonring
from trabecula.llm.token_counts import op9_length_histogram
from trabecula.llm.toxicity import op3_weak_supervision

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_skip_chain_crf": op1_skip_chain_crf,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_weak_supervision": op3_weak_supervision,
    "op4_block_naming": op4_block_naming,
    "op5_simhash_pigeonring": op5_simhash_pigeonring,
    "op6_typed_parts": op6_typed_parts,
    "op7_virtual_slots": op7_virtual_slots,
    "op8_sentence_rules": op8_sentence_rules,
    "op9_length_histogram": op9_length_histogram,
    "op10_qgram_bands": op10_qgram_bands,
    "op11_depth_bands": op11_depth_bands,
    "op12_bucket_pointers": op12_bucket_pointers,
    "op13_fm_index": op13_fm_index,
}

ORACLES: dict[str, str] = {
    "op6_typed_parts": OP6_SQL,
    "op8_sentence_rules": OP8_SQL,
    "op11_depth_bands": OP11_SQL,
    "op13_fm_index": OP13_SQL,
    "op4_block_naming": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
