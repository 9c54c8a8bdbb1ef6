"""The subpackage's queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe_tree, jaccard_join, knn_join, packing, pii, quality_pu, quality_trees, repair, secrets, suffix_dedup

QUERIES = {
    "op1_quality_pu": quality_pu.op1,
    "op2_quality_trees": quality_trees.op2,
    "op3_packing": packing.op3,
    "op4_bpe_tree": bpe_tree.op4,
    "op5_suffix_dedup": suffix_dedup.op5,
    "op6_secrets": secrets.op6,
    "op7_jaccard_join": jaccard_join.op7,
    "op8_pii": pii.op8,
    "op9_repair": repair.op9,
    "op10_knn_join": knn_join.op10,
}
SQL = {"op5_suffix_dedup": suffix_dedup.SQL, "op7_jaccard_join": jaccard_join.SQL, "op10_knn_join": knn_join.SQL}
