"""The queries of this subpackage, by name, and the SQL that some of them can be checked with."""

from __future__ import annotations

from feria.llm import decontaminate, licenses, mixing, near_dedup, pieces, prefix_trie, quality, spelling, stream_dedup, substring_dedup, token_files, url_filter, winnow

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op10_substring_dedup": substring_dedup.query,
    "op11_spelling": spelling.query,
    "op12_decontaminate": decontaminate.query,
    "op13_prefix_trie": prefix_trie.query,
    "op2_stream_dedup": stream_dedup.query,
    "op3_token_files": token_files.query,
    "op4_pieces": pieces.query,
    "op5_quality": quality.query,
    "op6_licenses": licenses.query,
    "op7_winnow": winnow.query,
    "op8_mixing": mixing.query,
    "op9_url_filter": url_filter.query,
}
ORACLES = {
    "op11_spelling": spelling.ORACLE,
    "op12_decontaminate": decontaminate.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
    "op2_stream_dedup": stream_dedup.ORACLE,
    "op6_licenses": licenses.ORACLE,
    "op8_mixing": mixing.ORACLE,
}
