"""Tables that are small as files but large in memory are not broadcast on an estimate."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["d8_ref_map_ids_and_names", "d9_ref_map", "d11_resolved_events", "e5_node_latency", "f1_emergent_edges", "g46_handoffs"])
def test_no_broadcast_on_file_sizes(spark, name):
    df = queries()[name](spark, SF)
    assert not re.findall("Broadcast(?:Hash|NestedLoop)Join", df._jdf.queryExecution().executedPlan().toString())
