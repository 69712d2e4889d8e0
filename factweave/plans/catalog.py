"""Registered queries and their oracles."""

from __future__ import annotations

from factweave.plans import change_queries, graph_queries, report_queries, text_queries, view_queries

QUERIES = {**graph_queries.QUERIES, **text_queries.QUERIES, **change_queries.QUERIES, **view_queries.QUERIES, **report_queries.QUERIES}
ORACLES = {**graph_queries.ORACLES, **text_queries.ORACLES, **change_queries.ORACLES, **view_queries.ORACLES, **report_queries.ORACLES}
