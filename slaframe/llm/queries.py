"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import (bpe, chat, exact_dedup, imatch, lattice, licenses, merkle, packing, parity_join, quality, runs,
               token_counts, warc)

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_ngram_jaccard_join": parity_join.op2_ngram_jaccard_join,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_warc": warc.op4_warc,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_imatch": imatch.op10_imatch,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_lattice_scores": lattice.op13_lattice_scores,
}

ORACLE_SQL = {
    "op2_ngram_jaccard_join": parity_join.SQL,
    "op4_warc": warc.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
}
