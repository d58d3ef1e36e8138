"""User SQL over named views, and example analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import register_sql_functions


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], sql: str, params: dict[str, object] | None = None) -> DataFrame:
    """A SELECT with named parameters over the tables as views; mos_score and grid_cell are known."""
    register_sql_functions(spark)
    register_views(tables)
    return spark.sql(sql, args=params or {})


#: Example analyses over a_mos (call_key, receiver, start, end, mos), a_incidents and a_transients.
CANNED = {
    "bad_receivers": "SELECT receiver, count(DISTINCT call_key) AS calls, sum(timestampdiff(MICROSECOND, start, end)) / 1e6 AS seconds FROM a_mos WHERE mos < :threshold GROUP BY receiver ORDER BY seconds DESC",
    "calls_with_episodes": "SELECT call_key, count(*) AS episodes FROM a_episodes GROUP BY call_key HAVING count(*) >= :least",
    "network_quality": "SELECT access, sum(timestampdiff(MICROSECOND, start, end)) / 1e6 AS seconds FROM a_mos WHERE mos < :threshold GROUP BY access",
    "metric_inventory": "SELECT metric, unit, count(*) AS samples FROM a_metrics GROUP BY metric, unit",
    "transients_by_platform": "SELECT platform, type, count(*) AS notices FROM a_transients GROUP BY platform, type",
    "open_incidents": "SELECT kind, observer, count(*) AS episodes FROM a_incidents WHERE status = 'open' GROUP BY kind, observer",
    "longest_incidents": "SELECT * FROM a_incidents WHERE duration_ms IS NOT NULL ORDER BY duration_ms DESC LIMIT :most",
    "cells": "SELECT grid_cell(latitude, longitude) AS cell, count(*) AS fixes FROM a_positions WHERE valid GROUP BY ALL",
    "failed_calls": "SELECT call_key, status FROM a_perspectives WHERE status = 'failed'",
    "coverage": "SELECT parser, count(*) AS files, sum(records) AS records FROM a_files GROUP BY parser",
}
