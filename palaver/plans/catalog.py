"""The registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import graph_queries, ingest_queries, message_queries, rollup_queries, search_queries, state_queries, token_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = [
    "ORACLE_SQL", "QUERIES", "graph_queries", "ingest_queries", "message_queries", "rollup_queries", "search_queries",
    "state_queries", "token_queries",
]
