"""Named queries over the driver's tables, with the same questions in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import audit_queries, evidence_queries, file_queries, sequence_queries, stream_queries, vector_queries  # noqa: F401
    from .registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    from .registry import ORACLES

    return dict(ORACLES)
