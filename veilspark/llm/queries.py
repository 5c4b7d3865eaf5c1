"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from . import centroid_clustering, exact_dedup, filter_audit, line_dedup, lm_scoring, minhash_dedup, mixing, ngram_join, nn_descent, packing, sharding, substring_dedup, toxicity

QUERIES = {
    "op5_nn_descent": nn_descent.op5_nn_descent,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op1_packing": packing.op1_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_sharding": sharding.op3_sharding,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op11_centroid_clustering": centroid_clustering.op11_centroid_clustering,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_ngram_join": ngram_join.op13_ngram_join,
}
SQL = {
    "op3_sharding": sharding.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_centroid_clustering": centroid_clustering.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
