"""The registered queries over the given tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analysis_queries, attempt_queries, audit_queries, build_queries, claim_queries, core_queries, log_queries, record_queries, stream_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = core_queries.QUERIES | log_queries.QUERIES | record_queries.QUERIES | analysis_queries.QUERIES | claim_queries.QUERIES | stream_queries.QUERIES | audit_queries.QUERIES | build_queries.QUERIES | attempt_queries.QUERIES
ORACLE_SQL: dict[str, str] = core_queries.ORACLE | log_queries.ORACLE | record_queries.ORACLE | analysis_queries.ORACLE | analysis_queries.MORE_ORACLES | claim_queries.ORACLE | stream_queries.ORACLE | audit_queries.ORACLE | build_queries.ORACLE | attempt_queries.ORACLE
