"""Queries gather and stream only what they use."""

from __future__ import annotations

import json

from spoor.plans.corpus import corpus
from spoor.plans.q_scans import documents
from spoor.plans.q_selection import event_times, stream_of

SF = "/root/testdata/sf0.001"


def test_documents_gather_one_layout_each(spark):
    c = corpus(spark, SF)
    graphs = {}
    for r in c.trade_edges.collect():
        graphs.setdefault(r.repo_id, set()).add(r.edge_id)
    seen = set()
    for r in documents(c).collect():
        doc, k = json.loads(r.raw), int(r.scan_id[5:])
        layout = "profile" if k % 7 == 0 else ("map", "list", "pairs")[k % 3]
        seen.add(layout)
        if layout == "map":
            assert set(doc["graph"]["edges"]) == graphs[r.scan_id] and doc["graph"]["nodes"]
        elif layout == "list":
            assert {e["edge_id"] for e in doc["graph"]["edges"]} == graphs[r.scan_id]
        elif layout == "pairs":
            assert len(doc["agent_relationships"]) == len(graphs[r.scan_id]) and doc["agent_definitions"]
        else:
            assert doc["total_capabilities"] == len(graphs[r.scan_id]) and "graph" not in doc
    assert seen == {"profile", "map", "list", "pairs"}


def test_stream_of_ids_reads_ids_only(spark):
    c = corpus(spark, SF)
    assert event_times(c).columns == ["repo_id", "event_id", "event_type", "timestamp_ns"]
    assert event_times(c).count() == c.table("events").count()
    stream_of(c)
    assert "event_files" not in c._kept
