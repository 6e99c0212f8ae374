"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from leadflow.llm import (centroids, chat, merkle, mixing, near_dedup, neighbours, packing, pivot_links, ranked_search,
                          suffix_dedup, token_output, toxicity, url_lists)

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_temporal_url_lists": url_lists.op2_temporal_url_lists,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_learned_partitions": neighbours.op4_learned_partitions,
    "op5_bit_plane_output": token_output.op5_bit_plane_output,
    "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
    "op10_merkle_fingerprints": merkle.op10_merkle_fingerprints,
    "op11_pivot_near_dedup": pivot_links.op11_pivot_near_dedup,
    "op12_k2treap_search": ranked_search.op12_k2treap_search,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}

ORACLES = {
    "op2_temporal_url_lists": url_lists.TEMPORAL_URL_SQL,
    "op8_source_mixing": mixing.MIXING_SQL,
    "op12_k2treap_search": ranked_search.SEARCH_SQL,
    "op13_centroid_clustering": centroids.CENTROID_SQL,
}
