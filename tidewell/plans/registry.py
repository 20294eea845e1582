"""All queries of the core, by name."""

from __future__ import annotations

from tidewell.plans import core_queries, landed_queries, training_queries


def queries() -> dict:
    return {**core_queries.QUERIES, **landed_queries.QUERIES, **training_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**core_queries.SQL, **landed_queries.SQL, **training_queries.SQL}
