"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import (ann, exact_dedup, fim, html_text, langid, licenses, line_dedup, mixing, near_dedup, packing, spelling,
               substring_dedup, top_search)
from .spark import Query

QUERIES: dict[str, Query] = {
    "op1_packing": packing.op1_packing,
    "op2_language_id": langid.op2_language_id,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_top_search": top_search.op5_top_search,
    "op6_minhash_dedup": near_dedup.op6_minhash_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_hash_prefix_forest": ann.op10_hash_prefix_forest,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}
ORACLES: dict[str, str] = {
    "op3_license_scan": licenses.OP3_SQL,
    "op5_top_search": top_search.OP5_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op13_exact_dedup": exact_dedup.OP13_SQL,
}
