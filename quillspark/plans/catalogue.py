"""All queries of the library and their DuckDB oracles."""

from __future__ import annotations

from quillspark.plans import export_queries, more_queries, relational_queries, search_queries, stream_queries, text_queries
from quillspark.plans.registry import ORACLES, QUERIES

__all__ = ["export_queries", "more_queries", "oracles", "queries", "relational_queries", "search_queries", "stream_queries", "text_queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
