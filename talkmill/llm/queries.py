"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from talkmill.llm import align, chat_format, divergence, fingerprints, license_scan, mixing, near_dups, neighbours, packing, quality, repeats, tokens, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_packing": packing.op3_packing,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_repeats": repeats.op5_repeats,
    "op6_quality": quality.op6_quality,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_mixing": mixing.op9_mixing,
    "op10_near_duplicates": near_dups.op10_near_duplicates,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op5_repeats": repeats.OP5_SQL,
    "op8_chat_format": chat_format.OP8_SQL,
    "op10_near_duplicates": near_dups.OP10_SQL,
    "op12_license_scan": license_scan.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
