"""Registered queries: motifs, knowledge base, fingerprints, risk prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.constants import ACTIVATION_START, PRECONDITIONS
from spoor.operators import fingerprint as I
from spoor.operators import graph as G
from spoor.operators import knowledge as H
from spoor.operators import lineage as L
from spoor.operators import motifs as M
from spoor.operators import risk as P
from spoor.plans.corpus import Corpus, Query, r6
from spoor.plans.q_failure import handoffs, resolved
from spoor.plans.q_overlay import NB, REACH, S_ERR, _BAD_END, behavior, closure, s_in
from spoor.sources.tables import with_ctes as W


def motif_nodes(c: Corpus):
    return c.keep("motif_nodes", lambda: M.motifs(c.nodes, c.edges))


def repos(c: Corpus):
    return c.keep("repo_behavior", lambda: H.repo_behavior(behavior(c)))


def fps(c: Corpus):
    return c.keep("fingerprints", lambda: I.fingerprints(c.nodes, c.edges, closure(c)))


def patterns(c: Corpus):
    return c.keep("patterns", lambda: H.patterns(motif_nodes(c), behavior(c), repos(c)))


def probs(c: Corpus):
    return c.keep("manifestations", lambda: H.manifestations(c.preconditions, repos(c)))


def fragile(c: Corpus):
    return c.keep("fragile_nodes", lambda: H.fragile_nodes(behavior(c), H.structural_roles(c.nodes, c.edges)))


def classified(c: Corpus):
    m = I.repo_motifs(motif_nodes(c), c.nodes)
    return m.join(I.type_counts(c.nodes).select("repo_id", "agent_count"), "repo_id").withColumn("archetype", I.archetype(F.col("motifs"), F.col("agent_count")))


def risks(c: Corpus):
    return P.predicted_risks(c.preconditions, probs(c), H.fragility_map(fragile(c)))


def scored(c: Corpus):
    return P.overall_risk(risks(c)).join(classified(c).select("repo_id", "archetype"), "repo_id")


_N = f"FILTER (event_type IN {s_in(ACTIVATION_START)})"
_BEH = NB + (
    f"bm AS (SELECT repo_id, node_id, count(*) {_N} AS ac, count(*) FILTER ({S_ERR}) AS fl, count(*) FILTER ({S_ERR} OR {_BAD_END}) AS er, count(*) FILTER (event_type = 'error.propagated') AS pr, "
    f"count(*) FILTER (({S_ERR} OR {_BAD_END}) AND error_handling IS NOT NULL) AS hn, count(*) FILTER (event_type = 'tool.call_failure' OR (event_type = 'tool.completed' AND status IN ('error', 'failure'))) AS tf, count(*) FILTER (event_type = 'tool.invoked') AS ti, count(*) FILTER (is_retry) AS rt, "
    "count(*) FILTER (event_type = 'decision.made') AS dm FROM ne GROUP BY ALL), "
    "be AS (SELECT n.repo_id, n.node_id, coalesce(ac, 0) AS ac, coalesce(fl, 0) / greatest(coalesce(ac, 0), 1) AS fr, coalesce(er, 0) AS er, coalesce(pr, 0) AS pr, coalesce(hn, 0) AS hn, coalesce(tf, 0) AS tf, coalesce(tf, 0) / greatest(coalesce(ti, 0), 1) AS tr, coalesce(rt, 0) AS rt FROM nodes n LEFT JOIN bm USING (repo_id, node_id)), "
    "rp AS (SELECT repo_id, bool_or(er > 0) AS failed, bool_or(fr > 0 OR (er > 0 AND hn > 0)) AS hrf, CAST(sum(er) AS BIGINT) AS te, CAST(sum(pr) AS BIGINT) AS cf FROM be GROUP BY repo_id), "
)
_MAN = _BEH + (
    "hs AS (SELECT precondition, count(*) AS n, count(*) FILTER (hrf) AS m, avg(te) FILTER (hrf AND te > 0) AS ae FROM pre JOIN rp USING (repo_id) GROUP BY 1), "
    "al AS (SELECT count(*) AS n, count(*) FILTER (hrf) AS f FROM rp), kn AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in PRECONDITIONS) + ") AS z(precondition)), "
    "mn AS (SELECT precondition, coalesce(hs.n, 0) AS sample_size, coalesce(m, 0) AS manifested, m / hs.n AS probability, ae, CASE WHEN hs.n > 0 THEN CASE WHEN ae > 10 THEN 'high' WHEN ae > 3 THEN 'medium' WHEN ae > 0 THEN 'low' ELSE 'none' END END AS severity_label, "
    "(al.f - m) / greatest(al.n - hs.n, 1) AS control, hs.n AS hn FROM kn LEFT JOIN hs USING (precondition), al), "
)
_ROLE = (
    "dg AS (SELECT n.repo_id, n.node_id, (SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id AND e.source = n.node_id) AS o, (SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id AND e.target = n.node_id) AS i, "
    "(SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id AND e.source = n.node_id AND edge_type = 'delegates_to') AS dd, (SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id AND e.target = n.node_id AND edge_type = 'delegates_to') AS di FROM nodes n), "
    "rl AS (SELECT repo_id, node_id, CASE WHEN o + i = 0 THEN 'isolated_node' WHEN o >= 3 THEN 'hub_node' WHEN dd = 0 AND i > 0 THEN 'leaf_node' WHEN di = 1 AND dd = 1 THEN 'chain_node' ELSE 'connector_node' END AS role FROM dg), "
)
_SS = (
    "ssw AS (SELECT repo_id, target AS store, source AS writer FROM edges WHERE edge_type = 'writes_to' AND target = 'ds_vector_store'), ssm AS (SELECT repo_id, store FROM ssw GROUP BY ALL HAVING count(*) >= 2), "
    "sss AS (SELECT * FROM ssm m WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = m.repo_id AND edge_type = 'arbitrated_by' AND m.store IN (e.source, e.target))), "
)
_IR = s_in(I.IRREVERSIBLE_EDGES)


def _loops(which: str) -> str:
    """Shortest cycle through every edge: all simple paths onward from its target, the best that ends at its source."""
    return (
        f"la AS (SELECT DISTINCT repo_id, source, target FROM edges WHERE {which}), lw AS (SELECT DISTINCT repo_id, [target] AS path FROM la UNION ALL SELECT w.repo_id, list_append(w.path, a.target) FROM lw w JOIN la a ON a.repo_id = w.repo_id AND a.source = w.path[-1] AND NOT list_contains(w.path, a.target)), "
        "lr AS (SELECT a.repo_id, a.source, a.target, path, list_position(path, list_min(path)) AS low FROM la a JOIN lw ON lw.repo_id = a.repo_id AND path[1] = a.target AND path[-1] = a.source QUALIFY row_number() OVER (PARTITION BY a.repo_id, a.source, a.target ORDER BY len(path), path) = 1), "
        "lp AS (SELECT DISTINCT repo_id, array_to_string(path[low:] || path[1:low - 1], '->') AS cycle FROM lr)"
    )



_CH = (
    "cd AS (SELECT repo_id, source, target FROM edges WHERE edge_type = 'delegates_to'), cr AS (SELECT DISTINCT repo_id, source AS root FROM cd WHERE NOT EXISTS (SELECT 1 FROM cd x WHERE x.repo_id = cd.repo_id AND x.target = cd.source)), "
    "cw AS (SELECT repo_id, root, [root] AS path FROM cr UNION ALL SELECT c.repo_id, c.root, list_append(c.path, d.target) FROM cw c JOIN cd d ON d.repo_id = c.repo_id AND d.source = c.path[-1] AND NOT list_contains(c.path, d.target) "
    "WHERE (SELECT count(*) FROM cd y WHERE y.repo_id = c.repo_id AND y.source = c.path[-1] AND NOT list_contains(c.path, y.target)) = 1), cl AS (SELECT repo_id, root, arg_max(path, len(path)) AS path FROM cw GROUP BY ALL), "
)
_MO = _SS + _CH + _loops("edge_type IN ('delegates_to', 'feeds_into')") + (
    ", hb AS (SELECT repo_id, source, list(target) AS t FROM cd GROUP BY ALL HAVING count(*) >= 3), tc AS (SELECT repo_id, source, target FROM edges WHERE (source = 'ext_web_api') <> (target = 'ext_web_api')), "
    "mo AS (SELECT DISTINCT * FROM (SELECT repo_id, 'shared_state_without_arbitration' AS motif, store AS instance, unnest(list_append(list(writer), store)) AS node_id FROM ssw JOIN sss USING (repo_id, store) GROUP BY repo_id, store "
    "UNION ALL SELECT repo_id, 'linear_delegation_chain', root, unnest(path) FROM cl WHERE len(path) >= 3 UNION ALL SELECT repo_id, 'hub_and_spoke', source, unnest(list_append(t, source)) FROM hb "
    "UNION ALL SELECT repo_id, 'feedback_loop', cycle, unnest(string_split(cycle, '->')) FROM lp UNION ALL SELECT repo_id, 'trust_boundary_crossing', 'all', unnest([source, target]) FROM tc)), mr AS (SELECT DISTINCT repo_id, motif FROM mo), "
)
_ARC = _MO + (
    "ms AS (SELECT r.repo_id, coalesce(list(motif) FILTER (motif IS NOT NULL), []) AS m, any_value(agents) AS agents FROM (SELECT repo_id, count(*) FILTER (node_type = 'agent') AS agents FROM nodes GROUP BY 1) r LEFT JOIN mr USING (repo_id) GROUP BY 1), "
    "ar AS (SELECT repo_id, CASE WHEN list_contains(m, 'linear_delegation_chain') AND list_contains(m, 'shared_state_without_arbitration') THEN 'hierarchical_delegation' WHEN list_contains(m, 'hub_and_spoke') AND list_contains(m, 'shared_state_without_arbitration') THEN 'hub_and_spoke_shared_state' "
    "WHEN list_contains(m, 'hub_and_spoke') THEN 'hub_and_spoke' WHEN list_contains(m, 'linear_delegation_chain') THEN 'linear_pipeline' WHEN list_contains(m, 'feedback_loop') THEN 'feedback_loop_system' WHEN list_contains(m, 'shared_state_without_arbitration') THEN 'shared_state_system' "
    "WHEN list_contains(m, 'trust_boundary_crossing') THEN 'trust_boundary_system' WHEN agents <= 1 THEN 'simple_agent' ELSE 'generic' END AS archetype FROM ms), "
)
_FRAG = _ROLE + (
    "de AS (SELECT repo_id, node_id, -sum(k / t * log2(k / t)) AS ent FROM (SELECT repo_id, node_id, count(*) AS k, sum(count(*)) OVER (PARTITION BY repo_id, node_id) AS t FROM ne WHERE event_type = 'decision.made' AND option_hash IS NOT NULL GROUP BY repo_id, node_id, option_hash) GROUP BY ALL), "
    "fn AS (SELECT be.*, role, tr > 0.1 OR rt > 0 AS qd, least(1, least(tr, 1) * 0.4 + CAST(tr > 0.1 OR rt > 0 AS INT) * 0.3 + least(rt / 10, 1) * 0.2 + least(coalesce(ent, 0) / 4, 1) * 0.1) AS sens FROM be JOIN rl USING (repo_id, node_id) LEFT JOIN de USING (repo_id, node_id) WHERE tf > 0 OR tr > 0.1 OR rt > 0 OR ac > 0), "
)
_RISK = _MAN + _FRAG + (
    "fp AS (SELECT DISTINCT precondition FROM (VALUES " + ", ".join(f"('{p}', '{r}')" for p, roles in P.PRECONDITION_ROLES.items() for r in roles) + ") AS z(precondition, role) WHERE role IN (SELECT role FROM fn GROUP BY role HAVING avg(sens) > 0.3)), "
    "rk AS (SELECT DISTINCT repo_id, precondition, probability, severity_label, precondition IN (SELECT precondition FROM fp) AS flag, probability * CASE severity_label WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 WHEN 'none' THEN 0 ELSE 1 END AS pw FROM pre JOIN mn USING (precondition) WHERE sample_size > 0), "
    "os AS (SELECT repo_id, sum(pw * CASE WHEN flag THEN 1.5::DOUBLE ELSE 1 END) / (count(*) * 4.5::DOUBLE) * 100 AS score, count(*) AS n FROM rk GROUP BY 1), "
    "ov AS (SELECT *, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' WHEN score >= 15 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level FROM os), "
)

QUERIES = [
    Query("h3_shared_state", lambda c: M.shared_state(c.nodes, c.edges), W("WITH " + _SS.rstrip(", ") + " SELECT repo_id, 'shared_state_without_arbitration' AS motif, store AS instance, unnest(list_append(list(writer), store)) AS node_id FROM ssw JOIN sss USING (repo_id, store) GROUP BY repo_id, store", "edges")),
    Query("h4_linear_chains", lambda c: M.linear_chains(c.edges), W(
        "WITH d AS (SELECT repo_id, source, target FROM edges WHERE edge_type = 'delegates_to'), r AS (SELECT DISTINCT repo_id, source AS root FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.repo_id = d.repo_id AND x.target = d.source)), "
        "ch AS (SELECT repo_id, root, [root] AS path FROM r UNION ALL SELECT c.repo_id, c.root, list_append(c.path, d.target) FROM ch c JOIN d ON d.repo_id = c.repo_id AND d.source = c.path[-1] AND NOT list_contains(c.path, d.target) "
        "WHERE (SELECT count(*) FROM d y WHERE y.repo_id = c.repo_id AND y.source = c.path[-1] AND NOT list_contains(c.path, y.target)) = 1), "
        "lg AS (SELECT repo_id, root, arg_max(path, len(path)) AS path FROM ch GROUP BY ALL) SELECT repo_id, 'linear_delegation_chain' AS motif, root AS instance, unnest(path) AS node_id FROM lg WHERE len(path) >= 3", "edges", recursive=True)),
    Query("h6_hub_and_spoke", lambda c: M.hubs(c.edges), W(
        "WITH d AS (SELECT repo_id, source, list(target) AS t FROM edges WHERE edge_type = 'delegates_to' GROUP BY ALL HAVING count(*) >= 3) SELECT repo_id, 'hub_and_spoke' AS motif, source AS instance, unnest(list_append(t, source)) AS node_id FROM d", "edges")),
    Query("h7_feedback_loops", lambda c: G.shortest_cycles(c.edges, types=["delegates_to", "feeds_into"]).select("repo_id", F.array_join("cycle", "->").alias("cycle")), W(
        "WITH " + _loops("edge_type IN ('delegates_to', 'feeds_into')") + " SELECT repo_id, cycle FROM lp", "edges", recursive=True)),
    Query("h7_simple_cycles", lambda c: G.simple_cycles(c.edges, types=["delegates_to", "feeds_into"]).select("repo_id", F.array_join("cycle", "->").alias("cycle")), W(
        "WITH d AS (SELECT DISTINCT repo_id, source, target FROM edges WHERE edge_type IN ('delegates_to', 'feeds_into')), w AS (SELECT repo_id, [source, target] AS path FROM d WHERE target > source UNION ALL SELECT w.repo_id, list_append(w.path, d.target) FROM w JOIN d ON d.repo_id = w.repo_id AND d.source = w.path[-1] AND d.target > w.path[1] AND NOT list_contains(w.path, d.target)) "
        "SELECT w.repo_id, array_to_string(path, '->') AS cycle FROM w JOIN d ON d.repo_id = w.repo_id AND d.source = w.path[-1] AND d.target = w.path[1]", "edges", recursive=True)),
    Query("h8_trust_crossings", lambda c: M.crossings(c.nodes, c.edges).select("repo_id", "edge_id"), W("SELECT repo_id, edge_id FROM edges WHERE (source = 'ext_web_api') <> (target = 'ext_web_api')", "edges")),
    Query("h1_patterns", lambda c: r6(patterns(c))),
    Query("h9_failure_modes_by_motif", lambda c: H.failure_mode_counts(motif_nodes(c), behavior(c)), W(
        "WITH " + _BEH + _MO + "hm AS (SELECT DISTINCT repo_id, node_id, error_handling AS mode FROM ne WHERE error_handling IS NOT NULL), hn AS (SELECT repo_id, mode, count(*) AS n FROM hm JOIN be USING (repo_id, node_id) WHERE er > 0 GROUP BY ALL) SELECT motif, mode, CAST(sum(n) AS BIGINT) AS n FROM mr JOIN hn USING (repo_id) GROUP BY ALL", "evl", "nodes", "edges", recursive=True)),
    Query("h11_novel_patterns", lambda c: r6(H.novel_patterns(repos(c)))),
    Query("h12_framework_comparison", lambda c: r6(H.framework_comparison(motif_nodes(c), c.nodes.select("repo_id", "framework").distinct(), repos(c)).drop("avg_error_rate", "avg_latency_p50_ms")), W(
        "WITH " + _BEH + _MO + "fw AS (SELECT DISTINCT repo_id, framework FROM nodes), "
        "d AS (SELECT motif, framework, count(*) AS n, count(*) FILTER (failed) AS k FROM mr JOIN fw USING (repo_id) JOIN rp USING (repo_id) GROUP BY ALL), w AS (SELECT *, k / n AS p, 1.959964 AS z FROM d) "
        "SELECT motif, framework, n AS sample_size, k AS repos_with_failure, round(p, 6) AS failure_rate, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)), 6) AS ci_low, "
        "round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)), 6) AS ci_high FROM w WHERE motif IN (SELECT motif FROM d GROUP BY motif HAVING count(*) >= 2)", "evl", "nodes", "edges", recursive=True)),
    Query("h15_h16_manifestations", lambda c: r6(probs(c).drop("ci_low", "ci_high")), W(
        "WITH " + _MAN.rstrip(", ") + " SELECT precondition, sample_size, manifested, round(probability, 6) AS probability, round(CASE WHEN hn > 0 THEN coalesce(ae, 0) END, 6) AS avg_errors, severity_label, round(control, 6) AS control_failure_rate, round(probability / greatest(control, 0.01), 6) AS relative_risk FROM mn", "evl", "nodes", "pre")),
    Query("h17_repo_failures", lambda c: repos(c).select("repo_id", "failed", "had_runtime_failures", "total_errors", "cascade_failures"), W("WITH " + _BEH.rstrip(", ") + " SELECT repo_id, failed, hrf AS had_runtime_failures, te AS total_errors, cf AS cascade_failures FROM rp", "evl", "nodes")),
    Query("h18_structure_metrics", lambda c: r6(H.structure_metrics(c.nodes, c.edges, repos(c)).drop("delegation_depth", "avg_propagation_rate")), W(
        "WITH " + _BEH.rstrip(", ") + " SELECT repo_id, CAST(9 AS DOUBLE) AS node_count, CAST(n AS DOUBLE) AS edge_count, round(n / 9, 6) AS betweenness_proxy, round(g / 9, 6) AS control_coverage, CAST(te AS DOUBLE) AS total_errors, CAST(cf AS DOUBLE) AS cascade_failures FROM rp JOIN (SELECT repo_id, count(*) AS n, count(*) FILTER (edge_type = 'filtered_by') AS g FROM edges GROUP BY 1) USING (repo_id)", "evl", "nodes", "edges")),
    Query("h18_correlations", lambda c: r6(H.correlations(H.structure_metrics(c.nodes, c.edges, repos(c))))),
    Query("h19_severity_scores", lambda c: r6(repos(c).join(closure(c).groupBy("repo_id").agg(F.max("depth").alias("d"), F.count_distinct("node").alias("k")), "repo_id").select("repo_id", H.severity_score(F.col("total_errors") / F.col("node_count"), F.col("d"), F.col("k"), F.col("node_count")).alias("severity"))), W(
        "WITH " + REACH + _BEH + "x AS (SELECT repo_id, max(depth) AS d, count(DISTINCT node) AS k FROM far GROUP BY 1) SELECT repo_id, round(least(te / 9 / 50, 1) * 30 + least(d / 5, 1) * 40 + k / 9 * 30, 6) AS severity FROM rp JOIN x USING (repo_id)", "evl", "nodes", "edges", recursive=True)),
    Query("h21_delegation_depth", lambda c: H.delegation_depth(c.edges), W(
        "WITH d AS (SELECT DISTINCT repo_id, source, target FROM edges WHERE edge_type = 'delegates_to'), r0 AS (SELECT DISTINCT repo_id, source FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.repo_id = d.repo_id AND x.target = d.source)), r AS (SELECT * FROM r0 UNION SELECT repo_id, source FROM d WHERE repo_id NOT IN (SELECT repo_id FROM r0)), "
        "w AS (SELECT repo_id, [source] AS path FROM r UNION ALL SELECT w.repo_id, list_append(w.path, d.target) FROM w JOIN d ON d.repo_id = w.repo_id AND d.source = w.path[-1] AND NOT list_contains(w.path, d.target)) SELECT repo_id, CAST(max(len(path)) AS INTEGER) AS delegation_depth FROM w GROUP BY 1", "edges", recursive=True)),
    Query("h22_structural_roles", lambda c: H.structural_roles(c.nodes, c.edges), W("WITH " + _ROLE.rstrip(", ") + " SELECT * FROM rl", "nodes", "edges")),
    Query("h24_fragility_map", lambda c: r6(H.fragility_map(fragile(c)).drop("sensitivity_score", "max_sensitivity_score")), W(
        "WITH " + _BEH + _ROLE + "f AS (SELECT be.*, role, tr > 0.1 OR rt > 0 AS qd FROM be JOIN rl USING (repo_id, node_id) WHERE tf > 0 OR tr > 0.1 OR rt > 0 OR ac > 0) SELECT role AS structural_position, round(avg(tr), 6) AS avg_tool_call_failure_rate, round(max(tr), 6) AS max_tool_call_failure_rate, count(DISTINCT repo_id) AS affected_repos_count, "
        "count(*) AS total_nodes_analyzed, round(avg(CAST(qd AS INT)), 6) AS quality_dependent_rate, round(avg(rt), 6) AS avg_retry_activations FROM f GROUP BY 1", "evl", "nodes", "edges")),
    Query("h24_top_fragile", lambda c: r6(H.top_fragile(fragile(c))), W(
        "WITH " + _BEH + _FRAG + "t AS (SELECT role, repo_id, node_id, sens, CAST(row_number() OVER (PARTITION BY role ORDER BY round(sens, 4) DESC, repo_id, node_id) AS INTEGER) AS rank FROM fn) SELECT role, rank, repo_id, node_id, round(sens, 6) AS sensitivity_score FROM t WHERE rank <= 5", "evl", "nodes", "edges")),
    Query("h25_interactions", lambda c: r6(H.interactions(c.preconditions, repos(c))), W(
        "WITH " + _BEH + "ids AS (SELECT DISTINCT precondition FROM pre), pf AS (SELECT repo_id, precondition, failed FROM pre JOIN rp USING (repo_id)), "
        "g AS (SELECT a.precondition AS a, b.precondition AS b, rp.failed, EXISTS (SELECT 1 FROM pre p WHERE p.repo_id = rp.repo_id AND p.precondition = a.precondition) AS ha, EXISTS (SELECT 1 FROM pre p WHERE p.repo_id = rp.repo_id AND p.precondition = b.precondition) AS hb FROM ids a JOIN ids b ON a.precondition < b.precondition, rp), "
        "c AS (SELECT a, b, count(*) FILTER (ha AND hb) AS n_both, count(*) FILTER (ha AND NOT hb) AS n_a_only, count(*) FILTER (hb AND NOT ha) AS n_b_only, count(*) FILTER (NOT ha AND NOT hb) AS n_neither, coalesce(avg(CAST(failed AS INT)) FILTER (ha AND hb), 0) AS pb, coalesce(avg(CAST(failed AS INT)) FILTER (ha AND NOT hb), 0) AS pa, "
        "coalesce(avg(CAST(failed AS INT)) FILTER (hb AND NOT ha), 0) AS pq, coalesce(avg(CAST(failed AS INT)) FILTER (NOT ha AND NOT hb), 0) AS pn FROM g GROUP BY ALL), e AS (SELECT *, CASE WHEN n_both >= 5 THEN pb / greatest(pa * pq / greatest(pn, 0.01), 0.01) END AS ef FROM c) "
        "SELECT a AS precondition_a, b AS precondition_b, n_both, n_a_only, n_b_only, n_neither, round(pb, 6) AS p_both, round(pa, 6) AS p_a_only, round(pq, 6) AS p_b_only, round(pn, 6) AS p_neither, round(ef, 6) AS interaction_effect, ef > 1.5 AS synergistic FROM e", "evl", "nodes", "pre")),
    Query("i1_fingerprints", lambda c: r6(fps(c).drop("feature_vector"))),
    Query("i4_node_type_shares", lambda c: r6(I.distribution(c.nodes, "node_type")), W("SELECT repo_id, node_type, count(*) AS n, round(count(*) / 9, 6) AS share FROM nodes GROUP BY ALL", "nodes")),
    Query("i5_edge_type_shares", lambda c: r6(I.distribution(c.edges, "edge_type")), W("WITH n AS (SELECT repo_id, edge_type, count(*) AS n FROM edges GROUP BY ALL) SELECT repo_id, edge_type, n, round(n / sum(n) OVER (PARTITION BY repo_id), 6) AS share FROM n", "edges")),
    Query("i6_shared_writers", lambda c: I.shared_writers(c.nodes, c.edges), W("SELECT repo_id, count(DISTINCT source) AS shared_state_writer_count FROM edges WHERE edge_type = 'writes_to' AND target = 'ds_vector_store' GROUP BY 1 HAVING count(DISTINCT source) >= 2", "edges")),
    Query("i8_irreversible", lambda c: I.irreversible(c.nodes, c.edges), W(f"SELECT repo_id, count(DISTINCT source) AS irreversible_capability_count FROM edges WHERE edge_type IN {_IR} AND source LIKE 'cap_%' GROUP BY 1", "edges")),
    Query("i11_delegation_levels", lambda c: I.delegation_depths(c.edges), W(
        "WITH d AS (SELECT DISTINCT repo_id, source, target FROM edges WHERE edge_type = 'delegates_to'), r0 AS (SELECT DISTINCT repo_id, source FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.repo_id = d.repo_id AND x.target = d.source)), r AS (SELECT * FROM r0 UNION SELECT repo_id, source FROM d WHERE repo_id NOT IN (SELECT repo_id FROM r0)), "
        "w AS (SELECT repo_id, source AS root, source AS node, 0 AS depth FROM r UNION SELECT w.repo_id, root, d.target, depth + 1 FROM w JOIN d ON d.repo_id = w.repo_id AND d.source = w.node WHERE depth < 9), b AS (SELECT repo_id, root, node, min(depth) AS depth FROM w GROUP BY ALL) SELECT repo_id, root, max(depth) + 1 AS depth FROM b GROUP BY ALL", "edges", recursive=True)),
    Query("i12_degrees", lambda c: G.degrees(c.nodes, c.edges), W("SELECT repo_id, node_id, (SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id AND e.source = n.node_id) AS out_degree, (SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id AND e.target = n.node_id) AS in_degree FROM nodes n", "nodes", "edges")),
    Query("i14_betweenness", lambda c: r6(G.betweenness(c.nodes, c.edges)), W(
        "WITH " + REACH + "sp AS (SELECT DISTINCT repo_id, source AS origin, source AS node, 0 AS depth FROM edges UNION ALL SELECT * FROM far), "
        "wk AS (SELECT DISTINCT repo_id, source AS origin, source AS node, 0 AS depth, CAST(1 AS BIGINT) AS k FROM edges UNION ALL SELECT w.repo_id, w.origin, e.target, w.depth + 1, w.k FROM wk w JOIN edges e ON e.repo_id = w.repo_id AND e.source = w.node JOIN sp ON sp.repo_id = w.repo_id AND sp.origin = w.origin AND sp.node = e.target AND sp.depth = w.depth + 1), "
        "sg AS (SELECT repo_id, origin, node, depth, sum(k) AS s FROM wk GROUP BY ALL), "
        "pr AS (SELECT a.repo_id, a.node AS v, sum(a.s * b.s / t.s) AS raw FROM sg a JOIN sg b ON b.repo_id = a.repo_id AND b.origin = a.node AND b.node <> a.node JOIN sg t ON t.repo_id = a.repo_id AND t.origin = a.origin AND t.node = b.node AND t.depth = a.depth + b.depth WHERE a.origin <> a.node AND a.origin <> b.node GROUP BY ALL) "
        "SELECT n.repo_id, n.node_id, round(coalesce(raw, 0) / 56, 6) AS betweenness FROM nodes n LEFT JOIN pr ON pr.repo_id = n.repo_id AND pr.v = n.node_id", "nodes", "edges", recursive=True)),
    Query("i15_error_paths", lambda c: I.error_paths(c.nodes, c.edges, closure(c)), W(
        "WITH " + REACH + "src AS (SELECT DISTINCT repo_id, CASE WHEN source = 'ext_web_api' THEN target ELSE source END AS n FROM edges WHERE (source = 'ext_web_api') <> (target = 'ext_web_api')), "
        f"snk AS (SELECT DISTINCT repo_id, source AS n FROM edges WHERE edge_type IN {_IR}) SELECT far.repo_id, count(*) AS error_propagation_path_count FROM far JOIN src ON src.repo_id = far.repo_id AND src.n = far.origin JOIN snk ON snk.repo_id = far.repo_id AND snk.n = far.node GROUP BY 1", "edges", recursive=True)),
    Query("i16_topology_hash", lambda c: I.topology_hash(c.edges), W(
        "SELECT repo_id, sha256('[' || string_agg('[\"' || source || '\",\"' || target || '\",\"' || edge_type || '\"]', ',' ORDER BY source, target, edge_type) || ']') AS topology_hash FROM edges GROUP BY 1", "edges")),
    Query("i3_normalization", lambda c: r6(I.normalization(c.table("embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("feature_vector")))), (
        "SELECT CAST(pos - 1 AS INTEGER) AS pos, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1")),
    Query("i2_normalized_fingerprints", lambda c: r6(I.normalized(fps(c), I.normalization(fps(c))).select("repo_id", F.posexplode("normalized").alias("pos", "value")))),
    Query("i17_i23_nearest_vectors", lambda c: _nearest(c), (
        "WITH q AS (SELECT label AS query_id, pos, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL), b AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), "
        "s AS (SELECT query_id, vec_id AS id, sum(q.v * b.v) / (sqrt(sum(q.v * q.v)) * sqrt(sum(b.v * b.v))) AS sim FROM q JOIN b USING (pos) GROUP BY ALL) SELECT query_id, id, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s QUALIFY rank <= 10")),
    Query("i21_archetypes", lambda c: r6(I.archetype_prevalence(classified(c))), W(
        "WITH " + _ARC + "n AS (SELECT archetype, count(*) AS repos FROM ar GROUP BY 1) SELECT archetype, repos, round(repos / sum(repos) OVER (), 6) AS prevalence FROM n", "nodes", "edges", recursive=True)),
    Query("i22_i24_matches", lambda c: r6(P.best_matches(P.exact_matches(I.repo_motifs(motif_nodes(c), c.nodes), patterns(c)), P.archetype_matches(classified(c), I.archetype_prevalence(classified(c)), patterns(c)))), W(
        "WITH " + _ARC + "pv AS (SELECT archetype, count(*) / sum(count(*)) OVER () AS p FROM ar GROUP BY 1) SELECT repo_id, 'pat_' || motif AS pattern_id, 1::DOUBLE AS similarity_score, 'exact_motif' AS match_type FROM mr UNION ALL SELECT repo_id, 'archetype_' || archetype, round(p, 6), 'archetype' FROM ar JOIN pv USING (archetype) WHERE archetype <> 'generic'", "nodes", "edges", recursive=True)),
    Query("i26_i28_match_context", lambda c: r6(P.match_context(P.exact_matches(I.repo_motifs(motif_nodes(c), c.nodes), patterns(c)), H.fragility_map(fragile(c)), c.preconditions, probs(c)))),
    Query("i29_overall_risk", lambda c: r6(P.overall_risk(risks(c))), W(
        "WITH " + _RISK.rstrip(", ") + " SELECT repo_id, round(score, 6) AS overall_risk_score, n AS predicted_risks, risk_level FROM ov", "evl", "nodes", "pre", "edges")),
    Query("i29_structural_only", lambda c: P.structural_only(c.preconditions, probs(c)), W("WITH " + _MAN.rstrip(", ") + " SELECT DISTINCT repo_id, precondition FROM pre JOIN mn USING (precondition) WHERE sample_size = 0", "evl", "nodes", "pre")),
    Query("i33_semantic_risk", lambda c: r6(P.semantic_risk(L.lineage_summary(handoffs(c), resolved(c))))),
    Query("i35_positive_signals", lambda c: P.positive_signals(c.nodes, c.edges, fps(c)).drop("shallow_delegation"), W(
        "SELECT repo_id, true AS guardrails, false AS human_checkpoint, coalesce((SELECT bool_or(edge_type = 'feeds_into') FROM edges e WHERE e.repo_id = r.repo_id), false) AS observability, coalesce((SELECT count(DISTINCT source) < 2 FROM edges e WHERE e.repo_id = r.repo_id AND edge_type = 'writes_to'), true) AS no_shared_state, true AS single_framework, "
        "EXISTS (SELECT 1 FROM edges e JOIN nodes n ON n.repo_id = e.repo_id AND n.node_id = e.source WHERE e.repo_id = r.repo_id AND e.target = 'ext_web_api' AND n.strategy IS NOT NULL) AS externals_guarded, (SELECT count(*) FROM edges e WHERE e.repo_id = r.repo_id) <= 18 AS low_complexity FROM (SELECT DISTINCT repo_id FROM nodes) r", "nodes", "edges")),
    Query("i37_behavior_texts", lambda c: risks(c).select("repo_id", "precondition", P.behavior_text().alias("text")), W(
        "WITH " + _RISK.rstrip(", ") + " SELECT repo_id, rk.precondition, format('{:.1f}', probability * 100) || ' % of ' || sample_size || ' repositories of this shape showed it; ' || CASE rk.severity_label WHEN 'high' THEN 'failures spread to other parts' WHEN 'medium' THEN 'failures stayed within their part' WHEN 'low' THEN 'failures were mostly caught where they arose' ELSE 'how far failures went was not measured' END AS text "
        "FROM (SELECT DISTINCT repo_id, precondition, severity_label FROM rk) rk JOIN mn USING (precondition)", "evl", "nodes", "pre", "edges")),
    Query("i39_similar_outcomes", lambda c: r6(P.similar_outcomes(motif_nodes(c), patterns(c))), W(
        "WITH " + _BEH + _MO + "rel AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{m}')" for p, ms in P.PRECONDITION_MOTIFS.items() for m in ms) + ") AS z(precondition, motif)), fr AS (SELECT motif, avg(CAST(failed AS INT)) AS failure_rate FROM mr JOIN rp USING (repo_id) GROUP BY 1), "
        "x AS (SELECT *, row_number() OVER (PARTITION BY motif ORDER BY repo_id) AS r FROM mr QUALIFY r <= 5) SELECT precondition, motif, repo_id, round(failure_rate, 6) AS failure_rate FROM rel JOIN x USING (motif) JOIN fr USING (motif) QUALIFY row_number() OVER (PARTITION BY precondition ORDER BY motif, r) <= 10", "evl", "nodes", "edges", recursive=True)),
    Query("i42_dataset_coverage", lambda c: P.dataset_coverage(c.preconditions, probs(c)), W("WITH " + _MAN.rstrip(", ") + " SELECT repo_id, count(*) AS preconditions_queried, count(*) FILTER (sample_size > 0) AS preconditions_with_data, CAST(sum(sample_size) AS BIGINT) AS total_sample_size FROM pre JOIN mn USING (precondition) GROUP BY 1", "evl", "nodes", "pre")),
    Query("i43_top_risks", lambda c: r6(P.top_risks(risks(c))), W(
        "WITH " + _RISK + "t AS (SELECT repo_id, precondition, round(pw, 9) AS w, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY round(pw, 9) DESC, precondition) AS INTEGER) AS rank FROM rk) SELECT repo_id, rank, precondition, round(w, 6) AS weight FROM t WHERE rank <= 3", "evl", "nodes", "pre", "edges")),
    Query("i46_i47_risk_distribution", lambda c: r6(P.risk_distribution(scored(c))), W(
        "WITH " + _RISK + _ARC + "z AS (SELECT risk_level, archetype, count(*) AS repos, round(avg(score), 6) AS mean_score FROM ov JOIN ar USING (repo_id) GROUP BY ALL) SELECT * FROM z", "evl", "nodes", "pre", "edges", recursive=True)),
    Query("i47_score_quantiles", lambda c: r6(P.score_quantiles(scored(c))), W(
        "WITH " + _RISK + "l AS (SELECT list_sort(list(score)) AS v, count(*) AS repos, avg(score) AS mean FROM ov) SELECT repos, round(mean, 6) AS mean, round(v[least(CAST(floor(repos * 0.5) AS BIGINT) + 1, repos)], 6) AS p50, round(v[least(CAST(floor(repos * 0.9) AS BIGINT) + 1, repos)], 6) AS p90 FROM l", "evl", "nodes", "pre", "edges")),
]


def _nearest(c: Corpus):
    """The ten vectors nearest to the mean vector of each label."""
    v = c.table("embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    pos = v.select("label", F.posexplode("vec").alias("p", "x")).groupBy("label", "p").agg(F.avg("x").alias("x"))
    q = pos.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("qvec"))
    return r6(I.nearest(q, v, k=10))
