"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import html, jaccard, langid, licenses, neighbours, packing, pieces, quality, substring, toxicity

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_language_id": langid.op6_language_id,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_approximate_neighbours": neighbours.op8_approximate_neighbours,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {
    "op1_substring_dedup": substring.SQL,
    "op2_ngram_jaccard": jaccard.SQL,
    "op7_quality_rules": quality.SQL,
}
