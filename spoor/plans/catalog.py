"""All registered queries."""

from __future__ import annotations

import importlib

from spoor.plans.corpus import Query

MODULES = ["q_rollup", "q_validation", "q_overlay", "q_edges", "q_failure", "q_knowledge", "q_scores", "q_text", "q_selection", "q_matching", "q_reference", "q_streams", "q_documents", "q_scans", "q_contacts", "q_reports", "q_triage", "q_names"]


def catalog() -> list[Query]:
    out: list[Query] = []
    for name in MODULES:
        out += importlib.import_module(f"spoor.plans.{name}").QUERIES
    names = [q.name for q in out]
    assert len(names) == len(set(names)), "duplicate query names"
    return out
