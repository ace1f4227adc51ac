"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import bpe, exactdedup, hilbert, linededup, packing, periodic, phrases, quality, secrets, sharding, simhash, warczip, windows

QUERIES = {
    "op1_simhash_pivots": simhash.op1,
    "op2_minimax_shards": sharding.op2,
    "op3_trigram_secrets": secrets.op3,
    "op4_warc_zip": warczip.op4,
    "op5_rule_ensemble": quality.op5,
    "op6_hilbert_curves": hilbert.op6,
    "op7_swap_packing": packing.op7,
    "op8_fuse_dedup": exactdedup.op8,
    "op9_line_bitmaps": linededup.op9,
    "op10_matrix_bpe": bpe.op10,
    "op11_window_hashes": windows.op11,
    "op12_periodic_runs": periodic.op12,
    "op13_collocations": phrases.op13,
}

ORACLE = {
    "op4_warc_zip": warczip.OP4_SQL,
    "op3_trigram_secrets": secrets.OP3_SQL,
    "op8_fuse_dedup": exactdedup.OP8_SQL,
    "op9_line_bitmaps": linededup.OP9_SQL,
    "op11_window_hashes": windows.OP11_SQL,
    "op12_periodic_runs": periodic.OP12_SQL,
    "op13_collocations": phrases.OP13_SQL,
}
