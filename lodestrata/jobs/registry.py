"""All registered queries outside the training-data operators, with their SQL."""

from __future__ import annotations

from . import accounting_queries, eligibility_queries, evidence_queries, preview_queries, retrieval_queries, source_queries, span_queries, streaming_queries, text_queries

MODULES = (eligibility_queries, text_queries, span_queries, retrieval_queries, evidence_queries, accounting_queries, streaming_queries, source_queries, preview_queries)


def queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
