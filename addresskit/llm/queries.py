"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import (decontaminate, divergence, language_id, license_scan, line_dedup, mixing, ngram_join, packing, pitman_yor, substring_dedup,
               url_filter, vector_codes, winnowing)

QUERIES = {f.__name__: f for f in (
    decontaminate.op1_decontaminate,
    pitman_yor.op2_lm_scoring,
    license_scan.op3_license_scan,
    mixing.op4_mix_sources,
    language_id.op5_language_id,
    url_filter.op6_url_filter,
    winnowing.op7_fingerprints,
    line_dedup.op8_line_dedup,
    substring_dedup.op9_substring_dedup,
    ngram_join.op10_ngram_join,
    vector_codes.op11_vector_codes,
    divergence.op12_source_divergence,
    packing.op13_pack,
)}

ORACLES = {
    "op4_mix_sources": mixing.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
}
