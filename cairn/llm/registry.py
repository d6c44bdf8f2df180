"""Queries of the corpus operators, and SQL twins where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import alignment, exact_dedup, html_text, licences, mixing, near_dedup, neighbours, packing, quality, token_count, toxicity, url_filter, whitening

QUERIES = {
    "op1_collision_counting": neighbours.op1,
    "op2_ngram_ratio_quality": quality.op2,
    "op3_simhash_bk_trees": near_dedup.op3,
    "op4_weighted_fair_queue": mixing.op4,
    "op5_token_counts": token_count.op5,
    "op6_cost_balanced_packing": packing.op6,
    "op7_boosted_dom_text": html_text.op7,
    "op8_link_trust": url_filter.op8,
    "op9_segment_toxicity": toxicity.op9,
    "op10_licence_paragraphs": licences.op10,
    "op11_perfect_hash_alignment": alignment.op11,
    "op12_qdwh_whitening": whitening.op12,
    "op13_block_naming": exact_dedup.op13,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op8_link_trust": url_filter.SQL, "op13_block_naming": exact_dedup.SQL}
