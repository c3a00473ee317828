"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chunk_recipes import OP3_SQL, op3_chunk_recipes
from .column_bwt import op10_column_bwt
from .ctw_scoring import op2_ctw_scoring
from .merkle_manifest import OP11_SQL, op11_merkle_manifest
from .minhash_join import OP7_SQL, op7_minhash_join
from .nnls_packing import op8_nnls_packing
from .progressive_jpeg import op9_progressive_jpeg
from .qda_quality import op1_qda_quality
from .temperature_mixing import op5_temperature_mixing
from .text_fingerprints import op12_text_fingerprints
from .tokenizer_alignment import op13_tokenizer_alignment
from .trie_counts import op4_trie_counts
from .two_pass_shuffle import op6_two_pass_shuffle

QUERIES = {
    "op1_qda_quality": op1_qda_quality,
    "op2_ctw_scoring": op2_ctw_scoring,
    "op3_chunk_recipes": op3_chunk_recipes,
    "op4_trie_counts": op4_trie_counts,
    "op5_temperature_mixing": op5_temperature_mixing,
    "op6_two_pass_shuffle": op6_two_pass_shuffle,
    "op7_minhash_join": op7_minhash_join,
    "op8_nnls_packing": op8_nnls_packing,
    "op9_progressive_jpeg": op9_progressive_jpeg,
    "op10_column_bwt": op10_column_bwt,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_text_fingerprints": op12_text_fingerprints,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL = {
    "op3_chunk_recipes": OP3_SQL,
    "op7_minhash_join": OP7_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
