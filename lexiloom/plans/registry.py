"""All queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from lexiloom.plans import consistency_queries, correction_queries, event_queries, family_queries, junction_queries, lexicon_queries, name_queries, propagation_queries, review_queries, rule_queries, spacing_queries

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (consistency_queries, lexicon_queries, correction_queries, event_queries, rule_queries, propagation_queries, review_queries, junction_queries, family_queries, name_queries, spacing_queries):
    for _name, (_query, _sql) in _module.ALL.items():
        if _name in QUERIES:
            raise ValueError(f"two queries are named {_name}")
        QUERIES[_name] = _query
        if _sql:
            ORACLE_SQL[_name] = _sql
