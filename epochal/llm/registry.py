"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from epochal.llm import hpylm, jaccard, mixing, neighbours, pieces, quality, sharding, spans, suffixes, urls

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_lm_scoring": hpylm.op2_lm_scoring,
    "op3_stratified_sharding": sharding.op3_stratified_sharding,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_nearest_neighbours": neighbours.op5_nearest_neighbours,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op6_jaccard_links": jaccard.op6_jaccard_links,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_sentence_spans": spans.op8_sentence_spans,
    "op9_mixing": mixing.op9_mixing,
    "op10_url_filters": urls.op10_url_filters,
}
SQL = {
    "op1_quality_rules": quality.OP1_SQL,
    "op6_jaccard_join": jaccard.OP6_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_url_filters": urls.OP10_SQL,
}
