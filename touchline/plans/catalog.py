"""All registered queries and the SQL of those that have one."""

from __future__ import annotations

from touchline.plans import file_queries, message_queries, model_queries, scoring_queries, table_queries

_PARTS = [part.REGISTRY for part in (table_queries, scoring_queries, message_queries, file_queries, model_queries)]

QUERIES = {name: build for part in _PARTS for name, build in part.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.oracles.items()}
