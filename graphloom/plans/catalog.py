"""Registered queries over a directory of tables, and their SQL."""

from __future__ import annotations

from . import q_graph, q_more, q_query, q_tables

FLAGSHIP = "naive_context"
_PARTS = (q_tables, q_graph, q_query, q_more)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
