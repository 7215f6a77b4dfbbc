"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import (
    ann_search, centroid_clusters, conversation_repair, exact_dedup, line_dedup, merge_replay, ngram_join, packing, quality,
    sentencepiece_codec, sharding, token_store, toxicity,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_nearest": ann_search.op3_nearest,
    "op4_quality": quality.op4_quality,
    "op5_token_store": token_store.op5_token_store,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_sharding": sharding.op10_sharding,
    "op11_merge_replay": merge_replay.op11_merge_replay,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_centroids": centroid_clusters.op13_centroids,
}

ORACLE = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op3_nearest": ann_search.OP3_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_centroids": centroid_clusters.OP13_SQL,
}
