"""The subpackage's queries and their SQL, for the registration in __spark_entry__.py."""

from . import blob_ledger, crf_language, cube, deleted_interpolation, gif, itq_neighbours, jaccard_join, line_chunks, piece_lattice, recompression

QUERIES = {
    "op1_deleted_interpolation": deleted_interpolation.op1_deleted_interpolation,
    "op2_blob_ledger": blob_ledger.op2_blob_ledger,
    "op3_cube": cube.op3_cube,
    "op4_line_chunks": line_chunks.op4_line_chunks,
    "op5_gif": gif.op5_gif,
    "op6_itq_neighbours": itq_neighbours.op6_itq_neighbours,
    "op7_piece_lattice": piece_lattice.op7_piece_lattice,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_recompression": recompression.op9_recompression,
    "op10_crf_language": crf_language.op10_crf_language,
}

ORACLE_SQL = {
    "op2_blob_ledger": blob_ledger.OP2_SQL,
    "op4_line_chunks": line_chunks.OP4_SQL,
    "op6_itq_neighbours": itq_neighbours.OP6_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
    "op9_recompression": recompression.OP9_SQL,
}
