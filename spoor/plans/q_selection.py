"""Registered queries: selection, run planning, feedback, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spoor.constants import PRECONDITION_FINDING
from spoor.operators import baselines as B
from spoor.operators import edges as E
from spoor.operators import failure as X
from spoor.operators import feedback as K
from spoor.operators import overlay as V
from spoor.operators import rollup as R
from spoor.operators import selection as N
from spoor.plans.corpus import Corpus, Query, r6
from spoor.plans.q_failure import _MET, _SPEC, _UNPIV, findings, traces
from spoor.plans.q_overlay import VAL
from spoor.plans.q_streams import ALERTS
from spoor.session import _checkpoint_dir
from spoor.sources import tables
from spoor.sources.tables import with_ctes as W
from spoor.streaming import events as S

# customers stand in for scanned repositories: their orders are agents, order lines are edges
_FIND = "CASE o_orderpriority WHEN '1-URGENT' THEN 'STRAT-DC-001' WHEN '2-HIGH' THEN 'STRAT-SI-001' WHEN '3-MEDIUM' THEN 'STRAT-OC-002' WHEN '4-NOT SPECIFIED' THEN 'TELEMETRY-X-001' ELSE 'STRAT-XCOMP-001' END"
_COLS = {
    "repo_id": "concat('repo_', c_custkey)", "framework": "CASE c_nationkey % 5 WHEN 0 THEN 'crewai' WHEN 1 THEN 'langgraph' WHEN 2 THEN 'autogen' WHEN 3 THEN 'langchain' ELSE 'custom' END",
    "archetype_id": "c_nationkey % 12", "agent_count": "n_orders", "edge_count": "n_lines", "delegation_depth": "b % 7", "shared_state_conflicts": "b % 4", "feedback_loops": "b % 3", "trust_crossings": "b % 5", "tool_types": "b % 10",
    "has_entry_point": "b % 2 = 0", "has_requirements": "b % 3 > 0", "standard_framework": "c_nationkey % 5 < 4", "has_usage": "b % 5 = 0", "requires_docker": "b % 7 = 0", "requires_database": "b % 11 = 0", "recent_commit": "b % 4 = 1",
    "topology_hash": "substring(md5(concat(n_orders, ':', n_lines)), 1, 8)", "estimated_runnability": "CAST(b % 100 AS DOUBLE) / 100", "is_xcomp": "b % 6 = 0", "b": "b",
}


def repos(c: Corpus):
    def build():
        n = c.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("k"))
        o = c.table("orders").join(n, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_lines"), F.sort_array(F.collect_set(F.expr(_FIND))).alias("finding_ids"))
        d = c.table("customer").withColumn("b", F.abs(F.expr("CAST(round(c_acctbal * 100) AS BIGINT)"))).join(o, "c_custkey", "left").fillna(0, ["n_orders", "n_lines"])
        none = F.array().cast("array<string>")
        d = d.withColumn("finding_ids", F.coalesce("finding_ids", none))
        d = d.select(*[F.expr(t).alias(k) for k, t in _COLS.items()], "finding_ids", F.size("finding_ids").cast("long").alias("precondition_count"))
        b = F.col("b")
        return d.withColumn("present_control_types", F.array_compact(F.array(F.when(b % 2 == 0, "human_gate"), F.when(b % 3 == 0, "timeout"), F.when(b % 5 == 0, "rate_limiter")))).withColumn(
            "xcomp_findings", F.when(F.col("is_xcomp"), F.array(F.lit("x"))).otherwise(none))

    return c.keep("selection_repos", build)


_RP = (
    "lk AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1), oa AS (SELECT o_custkey, count(*) AS n_orders, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_lines, "
    f"list_sort(list(DISTINCT {_FIND})) AS finding_ids FROM orders LEFT JOIN lk ON l_orderkey = o_orderkey GROUP BY 1), "
    "cu AS (SELECT customer.*, abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS b, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines, coalesce(finding_ids, []) AS finding_ids FROM customer LEFT JOIN oa ON o_custkey = c_custkey), "
    "rp AS MATERIALIZED (SELECT " + ", ".join(f"{t} AS {k}" for k, t in _COLS.items()) + ", finding_ids, len(finding_ids) AS precondition_count FROM cu), "
)
_SC = _RP + (
    "sc AS MATERIALIZED (SELECT *, CAST(10 * CAST(has_entry_point AS INT) + 5 * CAST(has_requirements AS INT) + 5 * CAST(standard_framework AS INT) + 3 * CAST(has_usage AS INT) + 3 * (1 - CAST(requires_docker AS INT)) + 2 * (1 - CAST(requires_database AS INT)) + 2 * CAST(recent_commit AS INT) AS DOUBLE) AS runnability_score, "
    "CAST(least(agent_count, 10) * 2 + least(edge_count, 30) * 0.5 + least(precondition_count, 10) * 1.5 + least(delegation_depth, 5) * 2 + least(shared_state_conflicts, 5) * 2 + CASE WHEN feedback_loops > 0 THEN 3 ELSE 0 END + CASE WHEN trust_crossings > 2 THEN 2 ELSE 0 END + least(tool_types, 8) * 0.5 AS DOUBLE) AS structural_value, "
    "CASE WHEN agent_count <= 2 AND edge_count <= 5 THEN 'low' WHEN agent_count <= 6 AND edge_count <= 20 THEN 'medium' ELSE 'high' END AS complexity FROM rp), s2 AS MATERIALIZED (SELECT *, structural_value + 30 + runnability_score AS selection_score FROM sc), "
)
_SEL = _SC + (
    "okk AS (SELECT * FROM s2 WHERE runnability_score >= 15), ct AS MATERIALIZED (SELECT repo_id FROM okk WHERE precondition_count <= 1 ORDER BY precondition_count, runnability_score DESC, repo_id LIMIT 60), "
    "re AS (SELECT *, row_number() OVER (PARTITION BY archetype_id ORDER BY selection_score DESC, repo_id) AS rk, count(*) OVER (PARTITION BY archetype_id) AS mem FROM okk WHERE repo_id NOT IN (SELECT repo_id FROM ct)), "
    "q2 AS (SELECT * FROM re WHERE rk <= 60), mu AS (SELECT * FROM q2 WHERE mem >= 10 AND rk <= 10), fi AS (SELECT * FROM q2 WHERE NOT (mem >= 10 AND rk <= 10) ORDER BY selection_score DESC, repo_id LIMIT greatest(340 - (SELECT count(*) FROM mu), 0)), "
)


def _selected(c: Corpus):
    return N.select_repos(N.scored(repos(c), 400), target=400, max_per_archetype=60, min_per_archetype=10)


def _discovery(c: Corpus):
    return c.keep("discovery", lambda: N.select_for_discovery(repos(c), 100))


def _runs(c: Corpus):
    p = c.preconditions.groupBy("repo_id").agg(F.collect_set("precondition").alias("pcs"))
    d = c.nodes.groupBy("repo_id").agg(F.count_if(F.col("node_type") == "agent").alias("agents"), F.when(F.min("framework") == "crewai", "high").otherwise("low").alias("complexity")).join(p, "repo_id", "left").withColumn("pcs", F.coalesce("pcs", F.array().cast("array<string>")))
    return d.select("repo_id", N.run_count(F.col("pcs"), F.col("agents"), F.col("complexity")).alias("runs"))


_RUNQ = (
    "rc AS (SELECT repo_id, CAST(least(7, 4 + CAST(coalesce(bool_or(precondition IN ('circular_delegation', 'capability_overlap_no_priority', 'data_store_no_schema_enforcement', 'classification_without_validation')), false) AS INT) + "
    "CAST(coalesce(bool_or(contains(precondition, 'classification') OR contains(precondition, 'semantic')), false) AS INT) + CAST(any_value(fw) = 'crewai' AS INT)) AS INTEGER) AS runs FROM (SELECT DISTINCT repo_id, framework AS fw FROM nodes) n LEFT JOIN pre USING (repo_id) GROUP BY repo_id), "
)


def _viable(c: Corpus):
    b = F.col("b")
    arr = lambda *p: F.array_compact(F.array(*[F.when(x, n) for n, x in p]))
    d = repos(c).select("repo_id", "topology_hash", arr(("docker", b % 7 == 0), ("database", b % 11 == 0)).alias("blockers"), arr(("async", b % 3 == 0), ("gpu", b % 4 == 0)).alias("risks"), arr(("main", b % 2 == 0), ("reqs", b % 5 > 0), ("tests", b % 9 == 0)).alias("signals"))
    d = d.withColumn("viability_score", N.viability())
    return N.demote_copies(d.withColumn("viability", N.viability_class(F.col("viability_score"), F.col("blockers"))))


def _queue(c: Corpus):
    b = F.col("b")
    p = lambda cond, n: F.when(cond, n).otherwise(0)
    d = repos(c).withColumn("score", N.enterprise_score([p(b % 2 == 0, 10), p(b % 3 == 0, 10), p(F.col("agent_count") >= 10, 5), p(F.col("agent_count") >= 5, 5)], [p(b % 5 > 0, 10), p(b % 7 == 0, 5), p(b % 4 == 0, 5), p(F.col("agent_count") >= 3, 5), p(b % 6 > 2, 5)],
                                                         [p(b % 3 > 0, 10), p(b % 2 > 0, 5), p(b % 9 == 0, 5), p(b % 5 == 0, 5), p(b % 8 > 3, 5)]))
    role = F.when(b % 6 == 0, "founder").when(b % 6 == 1, "lead").when(b % 6 == 2, "developer").otherwise("contributor")
    sev = F.when(b % 4 == 0, "critical").when(b % 4 == 1, "high").when(b % 4 == 2, "medium").otherwise("low")
    d = d.withColumn("tier", N.enterprise_tier(F.col("score"))).withColumn("priority", N.queue_priority(F.col("score"), b % 10 > 0, b % 3 == 1, role, sev))
    return d.select("repo_id", "score", "tier", "priority")


_QU = _RP + (
    "qa AS (SELECT repo_id, CAST(least(30, 10 * CAST(b % 2 = 0 AS INT) + 10 * CAST(b % 3 = 0 AS INT) + 5 * CAST(agent_count >= 10 AS INT) + 5 * CAST(agent_count >= 5 AS INT)) + least(35, 10 * CAST(b % 5 > 0 AS INT) + 5 * CAST(b % 7 = 0 AS INT) + 5 * CAST(b % 4 = 0 AS INT) + 5 * CAST(agent_count >= 3 AS INT) + 5 * CAST(b % 6 > 2 AS INT)) "
    "+ least(35, 10 * CAST(b % 3 > 0 AS INT) + 5 * CAST(b % 2 > 0 AS INT) + 5 * CAST(b % 9 = 0 AS INT) + 5 * CAST(b % 5 = 0 AS INT) + 5 * CAST(b % 8 > 3 AS INT)) AS INTEGER) AS score, "
    "CASE WHEN b % 10 > 0 THEN CASE WHEN b % 3 = 1 THEN 15 ELSE 0 END + CASE b % 6 WHEN 0 THEN 10 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 0 END ELSE 0 END + CASE b % 4 WHEN 0 THEN 25 WHEN 1 THEN 18 WHEN 2 THEN 10 ELSE 5 END AS bonus FROM rp), "
    "qu AS (SELECT repo_id, score, CASE WHEN score >= 70 THEN 'high_value' WHEN score >= 45 THEN 'enterprise' WHEN score >= 25 THEN 'prosumer' ELSE 'community' END AS tier, CAST(least(100, least(50, CAST(floor(score * 0.5::DOUBLE) AS INT)) + bonus) AS BIGINT) AS priority FROM qa), "
)


def stream_of(c: Corpus, events=None):
    """The corpus events as a file stream, from the files they have landed in; `events` may be a table of fewer columns."""
    path = (c.events if events is None else events).inputFiles()[0].rsplit("/", 1)[0]
    return S.event_stream(c.spark, path, fmt="parquet")


def event_times(c: Corpus):
    """Ids, types and times of all events; nothing else of an event is computed for them."""
    return c.keep("event_times", lambda: tables.events(c.spark, c.sf_dir).select("repo_id", "event_id", "event_type", "timestamp_ns"))


def streamed(c: Corpus, stream):
    base = f"{_checkpoint_dir(c.spark)}/streams/{uuid.uuid4().hex}"
    return S.run_to_table(stream, f"{base}/out", f"{base}/state", partitions=c.spark.sparkContext.defaultParallelism)


def _record(c: Corpus):
    runs = R.run_records(c.events).select("repo_id", "run_id", "total_events")
    ex = runs.groupBy("repo_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("total_events").alias("events"))
    return K.behavioral_records(ex, validated(c), emergent(c), activation(c), traces(c), modes(c), B.baselines(B.run_metrics(c.events)))


def validated(c):
    return c.keep("edge_validation", lambda: V.edge_validation(c.edges, c.events))


def emergent(c):
    return c.keep("emergent_by_discovery", lambda: E.emergent_by_discovery(c.events, c.edges))


def activation(c):
    return c.keep("node_activation", lambda: V.node_activation(c.nodes, c.events))


def modes(c):
    return c.keep("failure_modes", lambda: X.failure_modes(findings(c), c.events, traces(c)))


QUERIES = [
    Query("n6_n11_scores", lambda c: r6(N.scored(repos(c), 400).select("repo_id", "structural_value", "archetype_rarity", "runnability_score", "selection_score", "complexity")), "WITH " + _SC.rstrip(", ") + " SELECT repo_id, structural_value, CAST(30 AS DOUBLE) AS archetype_rarity, runnability_score, selection_score, complexity FROM s2"),
    Query("n12_selection", lambda c: _selected(c).select("repo_id", "selection_group"), "WITH " + _SEL.rstrip(", ") + " SELECT repo_id, 'control' AS selection_group FROM ct UNION ALL SELECT repo_id, 'treatment' FROM mu UNION ALL SELECT repo_id, 'treatment' FROM fi"),
    Query("n13_rescored_selection", lambda c: r6(N.scored(repos(c), 400, N.archetype_counts(_selected(c))).join(_selected(c).select("repo_id"), "repo_id", "left_semi").select("repo_id", "archetype_rarity", "selection_score")), (
        "WITH " + _SEL + "g AS (SELECT repo_id FROM ct UNION ALL SELECT repo_id FROM mu UNION ALL SELECT repo_id FROM fi), k AS (SELECT archetype_id, count(*) AS k FROM g JOIN s2 USING (repo_id) GROUP BY 1), "
        f"z AS (SELECT repo_id, greatest(0, 30 * (1 - k / (400 / {N.ARCHETYPES}))) AS rar, structural_value + runnability_score AS rest FROM g JOIN s2 USING (repo_id) JOIN k USING (archetype_id)) SELECT repo_id, round(rar, 6) AS archetype_rarity, round(rest + rar, 6) AS selection_score FROM z")),
    Query("n14_selection_summary", lambda c: r6(N.selection_summary(_selected(c))), (
        "WITH " + _SEL + "g AS (SELECT repo_id, 'control' AS selection_group FROM ct UNION ALL SELECT repo_id, 'treatment' FROM mu UNION ALL SELECT repo_id, 'treatment' FROM fi) SELECT selection_group, framework, count(*) AS repos, round(avg(selection_score), 6) AS mean_score FROM g JOIN s2 USING (repo_id) GROUP BY ALL")),
    Query("n15_discovery_values", lambda c: r6(repos(c).withColumn("_seen", F.lit(False)).select("repo_id", N.discovery_value({}).alias("value"))), (
        "WITH " + _RP.rstrip(", ") + " SELECT repo_id, round((15 + 10 + CASE WHEN agent_count BETWEEN 1 AND 999 THEN 8 ELSE 0 END + 6 * (CAST(list_contains(finding_ids, 'STRAT-DC-001') AS INT) + CAST(list_contains(finding_ids, 'STRAT-SI-001') AS INT) + CAST(list_contains(finding_ids, 'STRAT-OC-002') AS INT)) + 12 * CAST(list_contains(finding_ids, 'STRAT-XCOMP-001') AS INT) + 24) "
        "* (0.5::DOUBLE + 0.5::DOUBLE * estimated_runnability) + CASE WHEN is_xcomp THEN 8 ELSE 0 END, 6) AS value FROM rp")),
    Query("n16_discovery_sample", lambda c: _discovery(c).select("repo_id", "pick")),
    Query("n18_coverage_report", lambda c: N.coverage_report(_discovery(c), 100)),
    Query("n20_n30_best_per_fingerprint", lambda c: N.best_per_key(repos(c).filter(~N.telemetry_only(F.col("finding_ids"))).select("repo_id", "framework", "agent_count", "finding_ids", "estimated_runnability"), N.structural_fingerprint(), "estimated_runnability").select("repo_id", "framework", "agent_count"), (
        "WITH " + _RP.rstrip(", ") + " SELECT arg_max(repo_id, lpad(CAST(CAST(round(estimated_runnability * 100) AS INT) AS VARCHAR), 5, '0') || repo_id) AS repo_id, framework, agent_count FROM rp WHERE len(list_filter(finding_ids, lambda f: NOT starts_with(f, 'TELEMETRY'))) > 0 GROUP BY framework, agent_count, finding_ids")),
    Query("n22_rule_rarity", lambda c: r6(N.rule_rarity(repos(c))), "WITH " + _RP + "f AS (SELECT repo_id, unnest(finding_ids) AS f FROM rp), n AS (SELECT f, count(*) AS n FROM f GROUP BY 1) SELECT repo_id, round(sum((SELECT count(*) FROM rp) / n), 6) AS rarity FROM f JOIN n USING (f) GROUP BY 1"),
    Query("n25_ab_split", lambda c: N.split_ab(_selected(c), "selection_score").select("repo_id", "split"), (
        "WITH " + _SEL.rstrip(", ") + " SELECT repo_id, CASE WHEN (row_number() OVER (PARTITION BY framework ORDER BY selection_score DESC, repo_id) - 1) % 2 = 0 THEN 'A' ELSE 'B' END AS split FROM s2 WHERE repo_id IN (SELECT repo_id FROM ct UNION ALL SELECT repo_id FROM mu UNION ALL SELECT repo_id FROM fi)")),
    Query("n26_finding_prefixes", lambda c: repos(c).select("repo_id", F.array_join(F.sort_array(N.finding_prefixes(F.col("finding_ids"))), ",").alias("prefixes"), N.telemetry_only(F.col("finding_ids")).alias("telemetry_only")), (
        "WITH " + _RP.rstrip(", ") + " SELECT repo_id, array_to_string(list_sort(list_distinct(list_transform(finding_ids, lambda f: regexp_replace(f, '-[^-]*$', '')))), ',') AS prefixes, len(list_filter(finding_ids, lambda f: NOT starts_with(f, 'TELEMETRY'))) = 0 AS telemetry_only FROM rp")),
    Query("n34_diverse_order", lambda c: N.diverse_order(repos(c), "estimated_runnability").select("repo_id", "repeats"), "WITH " + _RP.rstrip(", ") + " SELECT repo_id, row_number() OVER (PARTITION BY topology_hash ORDER BY estimated_runnability DESC, repo_id DESC) > 1 AS repeats FROM rp"),
    Query("n36_n39_viability", lambda c: _viable(c).select("repo_id", "viability_score", "viability", "is_copy"), (
        "WITH " + _RP + "v AS (SELECT repo_id, topology_hash, CAST(b % 7 = 0 AS INT) + CAST(b % 11 = 0 AS INT) AS bl, CAST(b % 3 = 0 AS INT) + CAST(b % 4 = 0 AS INT) AS rk, CAST(b % 2 = 0 AS INT) + CAST(b % 5 > 0 AS INT) + CAST(b % 9 = 0 AS INT) AS sg FROM rp), s AS (SELECT *, CAST(least(100, greatest(0, 50 + 8 * sg - 5 * rk - 25 * bl)) AS INTEGER) AS vs FROM v) "
        "SELECT repo_id, vs AS viability_score, CASE WHEN bl >= 2 THEN 'likely_broken' WHEN bl = 1 THEN 'needs_probe' WHEN vs >= 70 THEN 'likely_runnable' WHEN vs >= 40 THEN 'needs_probe' ELSE 'skip' END AS viability, repo_id <> min(repo_id) OVER (PARTITION BY topology_hash) AS is_copy FROM s")),
    Query("n40_run_counts", lambda c: _runs(c), W("WITH " + _RUNQ.rstrip(", ") + " SELECT repo_id, runs FROM rc", "nodes", "pre")),
    Query("n42_budget", lambda c: r6(N.budget(_runs(c))), W("WITH " + _RUNQ.rstrip(", ") + " SELECT count(*) AS total_repos, CAST(sum(runs) AS BIGINT) AS total_runs, round(sum(runs) / count(*), 6) AS avg_runs_per_repo, round(sum(runs) * 5 / 60, 6) AS estimated_compute_hours FROM rc", "nodes", "pre")),
    Query("n43_run_plan", lambda c: N.run_plan(_runs(c)).select("repo_id", "run_number", "input_index", "input_hash"), W(
        "WITH " + _RUNQ + "p AS (SELECT repo_id, runs, unnest(generate_series(1, runs)) AS k FROM rc), q AS (SELECT *, CAST(CASE WHEN k <= (runs + 1) // 2 THEN k - 1 ELSE 0 END AS INTEGER) AS i FROM p) SELECT repo_id, CAST(k AS INTEGER) AS run_number, i AS input_index, substring(sha256(concat(repo_id, '#', i)), 1, 12) AS input_hash FROM q", "nodes", "pre")),
    Query("n45_n51_contact_queue", lambda c: _queue(c), "WITH " + _QU.rstrip(", ") + " SELECT * FROM qu"),
    Query("n52_tier_summary", lambda c: r6(N.tier_summary(_queue(c))), "WITH " + _QU.rstrip(", ") + " SELECT tier, count(*) AS repos, round(avg(priority), 6) AS mean_priority FROM qu GROUP BY 1"),
    Query("n56_activity_scores", lambda c: r6(repos(c).select("repo_id", N.activity_score(F.col("b") % 2000, F.col("agent_count"), F.col("b") % 365).alias("activity"))), (
        "WITH " + _RP.rstrip(", ") + " SELECT repo_id, CAST(CASE WHEN b % 2000 >= 1000 THEN 15 WHEN b % 2000 >= 100 THEN 10 WHEN b % 2000 >= 30 THEN 5 ELSE 2 END + least(agent_count * 0.5, 5) + CASE WHEN b % 365 < 30 THEN 5 WHEN b % 365 < 90 THEN 3 WHEN b % 365 < 180 THEN 1 ELSE 0 END AS DOUBLE) AS activity FROM rp")),
    Query("n57_diversity", lambda c: r6(N.diversity_ratio(repos(c))), "WITH " + _RP.rstrip(", ") + " SELECT count(*) AS repos, count(DISTINCT topology_hash) AS topologies, round(count(DISTINCT topology_hash) / count(*), 6) AS diversity FROM rp"),
    Query("n58_frameworks", lambda c: N.framework_census(repos(c)), "WITH " + _RP.rstrip(", ") + " SELECT framework, count(*) AS repos, count(*) FILTER (len(finding_ids) > 0) AS with_findings FROM rp GROUP BY 1"),
    # ---- records and feedback
    Query("g32_behavioral_records", lambda c: _record(c).select("repo_id", "schema_version", F.col("execution_metadata.runs").alias("runs"), F.col("edge_validation.structural_edges_dead").alias("dead_edges"), F.col("node_activation.conditional").alias("conditional_nodes"), F.col("error_propagation.traces").alias("traces"), F.size("monitoring_baselines").alias("baselines"))),
    Query("o3_finding_ids", lambda c: c.preconditions.select("precondition", K.finding_id(F.col("precondition")).alias("finding_id")).distinct(), W(
        "SELECT DISTINCT precondition, CASE precondition " + " ".join(f"WHEN '{p}' THEN '{f}'" for p, f in PRECONDITION_FINDING.items()) + " ELSE precondition END AS finding_id FROM pre", "pre")),
    Query("o4_emergent_heuristics", lambda c: r6(K.emergent_heuristics(emergent(c)))),
    Query("o5_edge_confidence", lambda c: r6(K.edge_confidence(V.activation_by_type(validated(c)))), W(
        "WITH " + VAL.rstrip() + ", t AS (SELECT repo_id, edge_type, count(*) FILTER (activation_count > 0) / count(*) AS s FROM val GROUP BY ALL) SELECT edge_type, round(avg(s), 6) AS mean_rate, round(min(s), 6) AS min_rate, round(max(s), 6) AS max_rate, count(*) AS sample_size FROM t GROUP BY 1", "ev", "edges")),
    Query("o6_failure_catalog", lambda c: r6(K.failure_catalog(modes(c)))),
    Query("o7_catalog_examples", lambda c: K.catalog_examples(X.signal_occurrences(c.events, traces(c)), traces(c))),
    Query("o9_metric_baselines", lambda c: r6(K.metric_baselines(B.baselines(B.run_metrics(c.events).withColumn("delegation_latency_p95_ms", F.col("delegation_latency_p95_ms") / 1e6))), 4), W(
        "WITH " + _MET + _UNPIV.replace("delegation_latency_p95_ms AS v", "delegation_latency_p95_ms / 1e6 AS v") + _SPEC.rstrip() + ", m AS (SELECT repo_id, metric, finding_id, avg(v) AS a FROM lg JOIN sp USING (metric) GROUP BY ALL) SELECT metric, finding_id, round(avg(a), 4) AS mean_baseline, count(*) AS repos FROM m GROUP BY ALL", "evl")),
    Query("o10_prediction_match", lambda c: r6(K.prediction_match(activation(c), traces(c)))),
    Query("b24_failure_prevalence", lambda c: r6(R.prevalence(modes(c)))),
    # ---- streams, run to the end of the data
    Query("p3_stream_distinct", lambda c: streamed(c, S.distinct_events(stream_of(c, event_times(c)).select("repo_id", "event_id", "event_type", "event_time"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("events")), W("SELECT event_type, count(*) AS events FROM ev GROUP BY 1", "ev")),
    Query("p4_stream_call_pairs", lambda c: streamed(c, S.call_pairs(stream_of(c), "INTERVAL 5 DAYS")).select("run_id", "event_id", "latency_ns"), W(
        "SELECT e.run_id, CAST(e.event_id AS VARCHAR) AS event_id, e.timestamp_ns - s.timestamp_ns AS latency_ns FROM evl e JOIN evl s ON s.run_id = e.run_id AND s.event_id = e.parent_id AND s.event_type IN ('agent.task_start', 'tool.invoked', 'llm.call_start', 'execution.start', 'delegation.initiated') "
        "WHERE e.event_type IN ('agent.task_end', 'tool.completed', 'llm.call_end', 'delegation.completed') AND e.timestamp_ns - s.timestamp_ns <= 432000000000000", "evl")),
    Query("p5_sliding_latency", lambda c: r6(S.windowed_latency(S.with_event_time(c.events), "1 hour", "1 hour").select(F.unix_seconds("window_start").alias("start_s"), "mean_latency_ms", "calls")), W(
        "SELECT CAST(floor(us / 3600000000) AS BIGINT) * 3600 AS start_s, round(avg(latency_ms), 6) AS mean_latency_ms, count(*) AS calls FROM ev WHERE event_type = 'llm.call_end' GROUP BY 1", "ev")),
    Query("p6_run_sessions", lambda c: S.run_sessions(S.with_event_time(c.events), "6 hours").select("repo_id", "run_id", "events", "errors", "start_ns", "end_ns"), W(
        "WITH g AS (SELECT *, CASE WHEN timestamp_ns - lag(timestamp_ns) OVER w < 21600000000000 THEN 0 ELSE 1 END AS brk FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY timestamp_ns)), s AS (SELECT *, sum(brk) OVER (PARTITION BY run_id ORDER BY timestamp_ns) AS sess FROM g) "
        "SELECT repo_id, run_id, count(*) AS events, count(*) FILTER (event_type LIKE 'error.%') AS errors, min(timestamp_ns) AS start_ns, max(timestamp_ns) AS end_ns FROM s GROUP BY repo_id, run_id, sess", "ev")),
    Query("p7_threshold_alerts", lambda c: r6(S.threshold_alerts(S.with_event_time(c.events), B.baselines(B.run_metrics(c.events)), "1 day").select("repo_id", F.unix_seconds("window_start").alias("start_s"), "tool_call_failure_rate", "calls")), ALERTS),
]
