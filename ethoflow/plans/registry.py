"""Names of queries, what runs them in Spark and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "behaviour_state_seconds"


def query(sql: str | None = None):
    """Registers a function under its name; sql gives the same rows in DuckDB."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


from . import queries_cohort, queries_exports, queries_models, queries_more, queries_pose, queries_sequence, queries_track  # noqa: E402, F401
