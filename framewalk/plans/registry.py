"""Queries over the driver's tables and the SQL that each must agree with."""

from __future__ import annotations

from framewalk.plans import box_queries, check_queries, source_queries, space_queries, stat_queries, state_queries, stream_queries

_PARTS = (state_queries, space_queries, box_queries, stat_queries, check_queries, source_queries, stream_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
