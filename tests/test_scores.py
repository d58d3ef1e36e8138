"""Scores of seconds and intervals of telemetry, whose planned size is much less than their rows', are never broadcast."""

import re

import pytest

import __spark_entry__ as entry

NAMES = ["a18_direct_cells", "a19_estimated_cells", "i18_route", "i19_route_points", "z6_pq_map"]


@pytest.mark.parametrize("name", NAMES)
def test_scores_of_seconds_stay_on_executors(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"(\w+Join) \[\w+#\d+L?, bin#\d+L?\], \[\w+#\d+L?, bin#\d+L?\], Inner", plan)
    assert "ShuffledHashJoin" in joins and "BroadcastHashJoin" not in joins


def test_intervals_of_telemetry_stay_on_executors(spark):
    plan = entry.queries()["z9_telemetry_job"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"(\w+Join) \[source_id#", plan)
    assert joins and set(joins) == {"SortMergeJoin"}
