"""Joins of graph levels broadcast nothing, however few rows they are measured to have."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["i14_betweenness"])
def test_no_broadcast_of_measured_rows(spark, name):
    df = queries()[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and not re.findall("Broadcast(?:Hash|NestedLoop)Join", plan)
