"""The registered queries of this subpackage and the SQL that tells their rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from .chat_format import SQL7, op7_chat_tokens
from .compression_rules import op10_compression_bands
from .decontaminate import op4_simhash_windows
from .hilbert import op1_hilbert_shards, op1_sql
from .pii_crf import op3_semi_markov_crf
from .maxent_lm import op2_hashed_maxent
from .pieces import op6_piece_scan
from .quality_fm import op8_factorisation_machine
from .simhash import op9_simhash_bitsliced
from .substring_lz import op5_lz_factors

QUERIES: dict[str, Callable] = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_hashed_maxent": op2_hashed_maxent,
    "op3_semi_markov_crf": op3_semi_markov_crf,
    "op4_simhash_windows": op4_simhash_windows,
    "op5_lz_factors": op5_lz_factors,
    "op6_piece_scan": op6_piece_scan,
    "op7_chat_tokens": op7_chat_tokens,
    "op8_factorisation_machine": op8_factorisation_machine,
    "op9_simhash_bitsliced": op9_simhash_bitsliced,
    "op10_compression_bands": op10_compression_bands,
}
ORACLE_SQL: dict[str, str] = {"op1_hilbert_shards": op1_sql(), "op7_chat_tokens": SQL7}
