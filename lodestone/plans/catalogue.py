"""All registered queries of the library."""

from __future__ import annotations

from lodestone.plans import event_queries, filter_queries, paper_queries, record_queries, source_queries, state_queries, text_queries, vector_queries
from lodestone.plans.registry import ORACLES, QUERIES

MODULES = (vector_queries, filter_queries, record_queries, event_queries, text_queries, paper_queries, state_queries, source_queries)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
