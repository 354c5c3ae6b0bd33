"""Every registered query with the SQL that checks it."""

from __future__ import annotations

from parley.plans import live_queries, model_queries, score_queries, session_queries, stream_queries, text_queries

PARTS = [stream_queries, score_queries, text_queries, session_queries, live_queries, model_queries]


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
