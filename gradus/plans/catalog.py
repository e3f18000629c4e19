"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from gradus.plans import graph_queries, hierarchy_queries, learning_queries, scoring_queries, signal_queries, stream_queries, text_queries

MODULES = (hierarchy_queries, text_queries, signal_queries, scoring_queries, graph_queries, learning_queries, stream_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
