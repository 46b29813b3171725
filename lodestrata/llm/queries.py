"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import conversation_trie, decontaminate, extract, filter_audit, jaccard, line_dedup, media, packing, quality, rollups, sentence_pieces, substrings, url_filter

MODULES = (substrings, quality, line_dedup, rollups, url_filter, decontaminate, jaccard, packing, media, extract, filter_audit, conversation_trie, sentence_pieces)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
