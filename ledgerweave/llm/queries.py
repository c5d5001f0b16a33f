"""The registered queries of the pipeline operators, and their SQL twins where SQL has one."""

from __future__ import annotations

from ledgerweave.llm.alignment import op13_diagonal_alignment
from ledgerweave.llm.bpe import op4_duckdb_bpe
from ledgerweave.llm.conversations import op12_viterbi_conversation_repair
from ledgerweave.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from ledgerweave.llm.fm_substrings import OP1_SQL, op1_fm_index_substrings
from ledgerweave.llm.minhash import OP9_SQL, op9_bottom_k_minhash
from ledgerweave.llm.mixing import OP10_SQL, op10_poisson_mixing
from ledgerweave.llm.pfp_substrings import op3_prefix_free_parsing
from ledgerweave.llm.quality import op2_tree_quality
from ledgerweave.llm.sharding import op5_histogram_shards
from ledgerweave.llm.token_counts import op7_digest_cache_counts
from ledgerweave.llm.toxicity import op6_subsequence_toxicity
from ledgerweave.llm.winnowing import OP11_SQL, op11_winnowing_decontamination

QUERIES = {
    f.__name__: f
    for f in (
        op1_fm_index_substrings,
        op2_tree_quality,
        op3_prefix_free_parsing,
        op4_duckdb_bpe,
        op5_histogram_shards,
        op6_subsequence_toxicity,
        op7_digest_cache_counts,
        op8_exact_dedup,
        op9_bottom_k_minhash,
        op10_poisson_mixing,
        op11_winnowing_decontamination,
        op12_viterbi_conversation_repair,
        op13_diagonal_alignment,
    )
}

ORACLE = {
    "op1_fm_index_substrings": OP1_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_bottom_k_minhash": OP9_SQL,
    "op10_poisson_mixing": OP10_SQL,
    "op11_winnowing_decontamination": OP11_SQL,
}
