"""Corpus reports on odd records."""

import json

from spoor.operators import corpus_reports as R


def docs(spark, *records):
    return R.read_records(spark.createDataFrame([(str(i), r if isinstance(r, (str, type(None))) else json.dumps(r)) for i, r in enumerate(records)], "record_id string, raw string"))


def test_quality_and_prevalence(spark):
    d = docs(spark, {}, None, "[1]", "{", {"edge_validation": {"a": 1}, "emergent_edges": "text", "error_propagation": [{"structural_prediction_match": True}, {}, 5], "failure_modes": [{"finding_id": "STRAT-SD-001", "manifestation_observed": True}, {"finding_id": "STRAT-SD-001"}]},
             {"failure_modes": {"not": "a list"}, "findings": [{"finding_id": "STRAT-HC-001"}, {"finding_id": None}], "error_propagation": []})
    q = R.record_quality(d).first()
    assert (q["records"], q["records_with_edge_validation"], q["records_with_emergent_edges"], q["records_with_error_propagation"], q["records_with_failure_modes_manifested"]) == (3, 1, 0, 1, 1) and abs(q["mean_match_rate"] - 1 / 3) < 1e-9
    assert {r["finding_id"]: (r["count"], r["rate"]) for r in R.finding_prevalence(d).collect() if r["count"]} == {"STRAT-SD-001": (1, 0.333), "STRAT-HC-001": (1, 0.333)}
    none = R.record_quality(docs(spark)).first()
    assert none["records"] == 0 and none["mean_match_rate"] == 0.0 and R.finding_prevalence(docs(spark)).count() == 5


def test_enrichments(spark):
    flow = lambda s, t: {"source_domains": s, "target_domains": t}
    rich = lambda **k: {"research_enrichments": k}
    d = docs(spark, {}, rich(), rich(privacy_topology={"error": "x", "privacy_exposure_score": 1.0, "cross_domain_flows": [flow(["z"], ["z"])]}), rich(privacy_topology={"privacy_exposure_score": 0.5, "cross_domain_flows": [flow(["b", "a"], ["c"]), flow(["a", "b"], ["c"])]}, audit_readiness={"frameworks_at_risk": ["gdpr", None]}),
             rich(privacy_topology={"cross_domain_flows": 5}, cost_risk={"token_amplification": {"max_amplification_ratio": 21}}))
    r = R.enrichment_report(d).first()
    assert (r["enriched_records"], r["mean_exposure_score"], r["repos_with_high_exposure"], r["repos_with_high_amplification"], r["repos_below_threshold"]) == (3, 0.25, 1, 1, 1)
    assert sorted((x["kind"], x["name"] or "", x["n"], x["rank"]) for x in R.enrichment_names(d).collect()) == [("flow", "", 2, 0), ("flow", "a,b->c", 2, 1), ("framework", "", 1, 0), ("framework", "gdpr", 1, 1)]
