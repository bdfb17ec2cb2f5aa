"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from . import chat_format, collocations, contamination, conversation_repair, language_id, mixing, packing, pitman_yor, quality, sharding, simhash, toxicity, training_order


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.query,
        "op2_robust_quality_rules": quality.query,
        "op3_ordinal_toxicity": toxicity.query,
        "op4_chat_formatting": chat_format.query,
        "op5_hash_tree_sharding": sharding.query,
        "op6_recurrent_language_id": language_id.query,
        "op7_pitman_yor_scoring": pitman_yor.query,
        "op8_source_mixing": mixing.query,
        "op9_positional_index_decontamination": contamination.query,
        "op9_positional_index_proximity": contamination.near_query,
        "op10_training_order": training_order.query,
        "op11_conversation_repair": conversation_repair.query,
        "op12_best_fit_packing": packing.query,
        "op13_phrase_collocations": collocations.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_formatting": chat_format.SQL,
        "op8_source_mixing": mixing.SQL,
        "op11_conversation_repair": conversation_repair.SQL,
        "op9_positional_index_decontamination": contamination.SQL,
    }
