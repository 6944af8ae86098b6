"""Registered queries: corpus reports over behavioral records of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.operators import corpus_reports as R
from spoor.plans.corpus import Corpus, Query, r6

IDS = R.SEMANTIC_FINDINGS


def records(c: Corpus):
    """One record per customer; which sections are filled, missing or failed follows from the key and the balance."""
    def build():
        k, b = F.col("c_custkey"), F.col("b")
        d = c.table("customer").withColumn("b", F.abs(F.expr("CAST(round(c_acctbal * 100) AS BIGINT)")))
        some = lambda cond, filled: F.when(cond, filled).otherwise(F.array().cast("array<int>"))
        traces = F.transform(F.slice(F.sequence(F.lit(0), F.lit(4)), F.lit(1), (k % 5).cast("int")), lambda i: F.struct(((k + i) % 2 == 0).alias("structural_prediction_match")))
        pick = lambda n: F.element_at(F.array(*map(F.lit, IDS)), (n % 5 + 1).cast("int"))
        modes = F.array(*[F.struct(pick(k + j).alias("finding_id"), (k % 2 == 0).alias("manifestation_observed")) for j in (0, 2)])
        modes = F.when(k % 7 == 0, F.slice(modes, 1, 0)).otherwise(modes)
        flow = F.struct(F.when(b % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("c"))).alias("source_domains"), F.array(F.concat(F.lit("t"), (b % 4).cast("string"))).alias("target_domains"))
        risk = F.when(b % 4 == 0, F.array(F.lit("gdpr"), F.lit("soc2"))).when(b % 4 == 1, F.array(F.lit("hipaa"))).otherwise(F.array().cast("array<string>"))
        fail = F.when(k % 10 == 0, "x")
        rich = F.struct(
            F.struct(fail.alias("error"), (b % 100 / 100).alias("privacy_exposure_score"), F.array(flow).alias("cross_domain_flows")).alias("privacy_topology"), F.struct((b % 50 / 50).alias("permission_risk_score"), (b % 20 / 20).alias("mean_utilization_rate"), (b % 3).alias("critical_asymmetries")).alias("permission_blast_radius"),
            F.struct((b % 25 / 25).alias("cost_risk_score"), F.struct((b % 40).alias("max_amplification_ratio")).alias("token_amplification"), F.struct((b % 10 / 10).alias("corpus_retry_rate")).alias("retry_waste")).alias("cost_risk"),
            F.struct((b % 80 / 80).alias("audit_readiness_score"), risk.alias("frameworks_at_risk")).alias("audit_readiness"))
        body = F.struct(
            F.when(k % 4 > 0, F.create_map(F.lit("e"), F.lit(1))).otherwise(F.create_map().cast("map<string,int>")).alias("edge_validation"), some(k % 3 > 0, F.array(F.lit(1))).alias("emergent_edges"), traces.alias("error_propagation"),
            F.when(k % 6 > 0, modes).alias("failure_modes"), F.when(k % 6 == 0, modes).alias("findings"), some(k % 8 > 0, F.array(F.lit(1))).alias("monitoring_baselines"), F.when(k % 9 > 0, rich).alias("research_enrichments"))
        return d.select(F.concat(F.lit("firm_"), k).alias("record_id"), F.to_json(body).alias("raw"))

    return R.read_records(c.keep("report_records", build))


def evidence(c: Corpus):
    """One evidence document per brand: its parts are findings, ranked remediations by size."""
    p = c.table("part")
    ranked = F.when(F.col("p_size") % 3 > 0, F.array(F.struct(F.concat(F.lit("use "), "p_type").alias("name")), F.struct(F.lit("wait").alias("name"))))
    item = F.struct(F.concat(F.lit("F-"), F.col("p_partkey").cast("string")).alias("finding_id"), F.when(F.col("p_size") % 2 == 0, "high").alias("severity"), F.struct((F.col("p_size") / 64).alias("manifestation_rate")).alias("corpus_statistics"), ranked.alias("priority_ranked_remediations"), F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (F.col("p_size") % 4).cast("int")).alias("remediation_candidates"))
    docs = p.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(item).alias("evidence"))).alias("raw"))
    return R.read_records(docs.select(F.col("p_brand").alias("record_id"), "raw"))


_REC = (
    "cb AS MATERIALIZED (SELECT c_custkey AS k, abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS b FROM customer), "
    "fm AS (SELECT k, k % 2 = 0 AS shown, i FROM cb, (VALUES (0), (2)) AS t(j), range(5) AS r(i) WHERE k % 7 > 0 AND (k + j) % 5 = i), "
    "en AS MATERIALIZED (SELECT *, k % 10 > 0 AS sound FROM cb WHERE k % 9 > 0), "
)
_NAMES = ", ".join(f"({i}, '{f}')" for i, f in enumerate(IDS))

QUERIES = [
    Query("b23_record_quality", lambda c: r6(R.record_quality(records(c))), "WITH " + _REC + (
        "mr AS (SELECT k, avg(CAST((k + i) % 2 = 0 AS INT)) AS m FROM cb, range(5) AS t(i) WHERE i < k % 5 GROUP BY k) SELECT count(*) AS records, count(*) FILTER (k % 4 > 0) AS records_with_edge_validation, count(*) FILTER (k % 3 > 0) AS records_with_emergent_edges, count(*) FILTER (k % 5 > 0) AS records_with_error_propagation, "
        "count(*) FILTER (k % 8 > 0) AS records_with_monitoring_baselines, count(*) FILTER (k % 6 > 0 AND k % 7 > 0 AND k % 2 = 0) AS records_with_failure_modes_manifested, round((SELECT avg(m) FROM mr), 6) AS mean_match_rate FROM cb")),
    Query("b27_finding_prevalence", lambda c: R.finding_prevalence(records(c)), "WITH " + _REC + f"nm AS (SELECT * FROM (VALUES {_NAMES}) AS t(i, f)) SELECT f AS finding_id, count(DISTINCT fm.k) AS count, round(count(DISTINCT fm.k) / (SELECT count(*) FROM cb), 3) AS rate FROM nm LEFT JOIN fm USING (i) GROUP BY f"),
    Query("b28_enrichment_report", lambda c: R.enrichment_report(records(c)), "WITH " + _REC.rstrip(", ") + (
        " SELECT count(*) AS enriched_records, round(avg(b % 100 / 100) FILTER (sound), 3) AS mean_exposure_score, count(*) FILTER (sound AND b % 100 / 100 > 0.3::DOUBLE) AS repos_with_high_exposure, round(avg(b % 50 / 50), 3) AS mean_permission_risk, count(*) FILTER (b % 3 > 0) AS repos_with_critical_asymmetries, round(avg(b % 20 / 20), 3) AS mean_utilization_rate, "
        "round(avg(b % 25 / 25), 3) AS mean_cost_risk, count(*) FILTER (b % 40 > 20) AS repos_with_high_amplification, round(avg(b % 10 / 10), 3) AS mean_retry_rate, round(avg(b % 80 / 80), 3) AS mean_readiness_score, count(*) FILTER (b % 80 < 40) AS repos_below_threshold FROM en")),
    Query("b28_leading_names", lambda c: r6(R.enrichment_names(records(c)).filter("rank <= 10")), "WITH " + _REC + (
        "fa AS (SELECT 'flow' AS kind, CASE WHEN b % 2 = 0 THEN 'a,b' ELSE 'c' END || '->t' || b % 4 AS name FROM en WHERE sound UNION ALL SELECT 'framework', unnest(CASE b % 4 WHEN 0 THEN ['gdpr', 'soc2'] WHEN 1 THEN ['hipaa'] ELSE [] END) FROM en), "
        "fn AS (SELECT kind, name, count(*) AS n FROM fa GROUP BY ALL UNION ALL SELECT kind, NULL, count(*) FROM fa GROUP BY ALL) SELECT kind, name, n, round(n / max(n) OVER (PARTITION BY kind), 6) AS share, CAST(row_number() OVER (PARTITION BY kind ORDER BY name IS NULL DESC, n DESC, name) - 1 AS INTEGER) AS rank FROM fn QUALIFY rank <= 10")),
    Query("b29_remediation_report", lambda c: r6(R.remediation_report(evidence(c))), "SELECT 'F-' || p_partkey AS finding_id, CASE WHEN p_size % 2 = 0 THEN 'high' END AS severity, round(p_size / 64, 6) AS corpus_prevalence, CASE WHEN p_size % 3 > 0 THEN 'use ' || p_type END AS top_remediation, p_size % 4 AS candidate_count FROM part"),
]
