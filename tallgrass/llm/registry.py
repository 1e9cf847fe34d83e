"""Queries of the training-data operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import binary_packing, exact_topk, fill_middle, language_id, merkle_manifest, near_dedup, piece_codec, quality_rules, secrets_cnn, tier_packing, token_counts, toxicity, warc

QUERIES = {
    "op1_arc_to_warc": warc.op1_arc_to_warc,
    "op2_bottom_k_dedup": near_dedup.op2_bottom_k_dedup,
    "op3_norm_sorted_top_k": exact_topk.op3_norm_sorted_top_k,
    "op4_tier_packing": tier_packing.op4_tier_packing,
    "op5_digest_cache_counts": token_counts.op5_digest_cache_counts,
    "op6_ftrl_language": language_id.op6_ftrl_language,
    "op7_char_cnn_secrets": secrets_cnn.op7_char_cnn_secrets,
    "op8_best_fit_binary": binary_packing.op8_best_fit_binary,
    "op9_marked_word_pieces": piece_codec.op9_marked_word_pieces,
    "op10_rule_cascade": quality_rules.op10_rule_cascade,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_bayes_scaled_toxicity": toxicity.op12_bayes_scaled_toxicity,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op1_arc_to_warc": warc.OP1_SQL,
    "op2_bottom_k_dedup": near_dedup.OP2_SQL,
    "op3_norm_sorted_top_k": exact_topk.OP3_SQL,
    "op10_rule_cascade": quality_rules.OP10_SQL,
    "op11_fill_in_middle": fill_middle.OP11_SQL,
    "op13_merkle_manifest": merkle_manifest.OP13_SQL,
}
