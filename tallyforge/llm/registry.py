"""The queries of this subpackage and the SQL that some of them are compared with."""

from __future__ import annotations

from tallyforge.llm import conversations, decontaminate, embedding_join, hard_negatives, html_text, langid, packing, pii, repeats, sharding, simhash, tokencount, warc


def queries() -> dict:
    return {
        "op1_hash_tree_shards": sharding.op1_hash_tree_shards,
        "op2_seed_align": decontaminate.op2_seed_align,
        "op3_grid_join": embedding_join.op3_grid_join,
        "op4_max_subsequence": html_text.op4_max_subsequence,
        "op5_feistel_pii": pii.op5_feistel_pii,
        "op6_simhash_cover": simhash.op6_simhash_cover,
        "op7_prefix_doubling": repeats.op7_prefix_doubling,
        "op8_ftrl_language": langid.op8_ftrl_language,
        "op9_count_viterbi": tokencount.op9_count_viterbi,
        "op10_best_fit": packing.op10_best_fit,
        "op11_pca_negatives": hard_negatives.op11_pca_negatives,
        "op12_structure_repair": conversations.op12_structure_repair,
        "op13_warc_salvage": warc.op13_warc_salvage,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_hash_tree_shards": sharding.oracle_sql(),
        "op3_grid_join": embedding_join.ORACLE_SQL,
        "op11_pca_negatives": hard_negatives.ORACLE_SQL,
        "op13_warc_salvage": warc.ORACLE_SQL,
    }
