"""Declared constraints on small tables with every rule broken once."""

import json

from pyspark.sql import functions as F

from spoor.operators import constraints as C

GOOD = {"repo_id": "https://github.com/a/b", "repo_hash": "x", "framework": "f", "scan_status": "SUCCESS", "runs": [
    {"agents": [{"agent_name": "A", "tasks": [{"output_text": "hi"}]}], "delegation_chains": [{"upstream_agent": "A", "downstream_agent": "B"}]},
    {"agents": [{"agent_name": "B", "tasks": []}], "delegation_chains": [{"upstream_agent": "A", "downstream_agent": "B"}]}]}


def test_export_rules(spark):
    bad = {k: v for k, v in GOOD.items() if k != "framework"} | {"repo_id": "nope", "runs": []}
    silent = GOOD | {"runs": [{"agents": [{"agent_name": "A", "tasks": [{"output_text": ""}]}]}], "repo_id": "https://github.com/c"}
    lines = [(1, json.dumps(GOOD)), (2, "{brok"), (3, "[1]"), (4, json.dumps(bad)), (5, json.dumps(GOOD)), (6, "  "), (7, None), (8, json.dumps(silent))]
    found, seen = C.export_violations(spark.createDataFrame(lines, "line long, raw string"))
    assert sorted((r["key"], r["rule"], r["detail"]) for r in found.collect()) == [
        ("1", "unknown_downstream", "B"), ("2", "invalid_json", ""), ("3", "not_an_object", ""), ("4", "missing_field", "framework"), ("4", "no_runs", "nope"), ("4", "not_a_github_url", "nope"),
        ("5", "duplicate_repo_id", "https://github.com/a/b"), ("5", "unknown_downstream", "B"), ("8", "no_output", "https://github.com/c")]
    assert seen == {"rows": 6, "repos": 4, "success": 4, "partial": 0}
    none, seen = C.export_violations(spark.createDataFrame([], "line long, raw string"))
    assert none.count() == 0


def test_record_rules(spark):
    t = {"error_source_node": "a", "structural_predicted_path": [], "actual_observed_path": ["a"], "stop_mechanism": "x", "downstream_impact": {k: 1 for k in C.IMPACT_KEYS}}
    rec = {k: {} for k in C.RECORD_KEYS} | {"error_propagation": [t, t | {"stop_mechanism": 3}, t | {"actual_observed_path": "a", "downstream_impact": {"nodes_affected": 2}}, 5, {}]}
    short = {k: v for k, v in rec.items() if k != "failure_modes"} | {"error_propagation": {}}
    got = C.record_violations(spark.createDataFrame([("p", json.dumps(rec)), ("q", json.dumps(short))], "repo_id string, raw string")).collect()
    assert sorted((r["key"], r["detail"], r["rule"]) for r in got) == sorted([
        ("q", "failure_modes", "missing_section"), ("p", "[1]", "stop_mechanism_no_text"), ("p", "[2]", "observed_path_no_list"), *[("p", f"[2].{k}", "impact_counter_missing") for k in C.IMPACT_KEYS[1:]],
        *[("p", "[4]", r) for r in ("trace_without_source", "predicted_path_no_list", "observed_path_no_list", "stop_mechanism_no_text", "impact_without_nodes")]])


def test_references_and_counters(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, None, 7), (3, "a", 7)], "k int, ref string, n int")
    other = spark.createDataFrame([("a",), ("a",), (None,)], "ref string")
    c = C.Constraints("t", F.col("k"), [C.Rule("big", F.col("n") > 6, F.col("n"))], [C.Unique("twice", ["ref"], "k")], [C.Reference("known", ["ref"], other)])
    found, seen = C.violations(df, c, {"total": F.sum("n")})
    assert sorted((r["rule"], r["key"], r["detail"]) for r in found.collect()) == [("big", "3", "7"), ("big", "3", "7"), ("known", "2", "b"), ("twice", "3", "a")]
    assert seen == {"rows": 4, "total": 19}
