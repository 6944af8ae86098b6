"""Registered queries: permissions, privacy, cost, audit, vulnerability, Markov model."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.constants import DATA_DOMAINS, FINDING_REGULATIONS, TOOL_PERMISSIONS
from spoor.operators import audit as A
from spoor.operators import cost as C
from spoor.operators import exposure as X
from spoor.operators import markov as K
from spoor.plans.corpus import Corpus, Query, r6
from spoor.plans.q_failure import resolved
from spoor.plans.q_overlay import EVR, REACH, REFMAP, closure
from spoor.sources.tables import with_ctes as W


def s_classes(x: str, table: dict[str, list[str]], default: str) -> str:
    arms = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({x}), '{k}')" for k in table[c]) + f" THEN '{c}' END" for c in sorted(table))
    found = f"list_filter([{arms}], lambda q: q IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE ['{default}'] END"


_RZ = REFMAP + EVR + "rz AS (SELECT *, coalesce(src, source_id) AS rs FROM evr), "
_PERM = _RZ + (
    f"tp AS (SELECT DISTINCT tool_name, {s_classes('tool_name', TOOL_PERMISSIONS, 'read_data')} AS cl FROM ev WHERE tool_name IS NOT NULL), "
    "dp AS (SELECT DISTINCT repo_id, rs AS node_id, c FROM (SELECT repo_id, rs, unnest(cl) AS c FROM rz JOIN tp USING (tool_name) WHERE event_type = 'tool.invoked' AND rs <> '')), "
    "up AS (SELECT DISTINCT repo_id, rs AS node_id, c FROM (SELECT repo_id, rs, unnest(cl) AS c FROM rz JOIN tp USING (tool_name) WHERE event_type = 'tool.completed' AND rs <> '')), "
    "dn AS (SELECT repo_id, node_id, string_agg(c, ',' ORDER BY c) AS direct, count(*) AS k FROM dp GROUP BY ALL), "
)
_TRANS = _PERM + (
    "tr AS (SELECT DISTINCT dn.repo_id, dn.node_id, d.c FROM dn JOIN far ON far.repo_id = dn.repo_id AND far.origin = dn.node_id JOIN dp d ON d.repo_id = far.repo_id AND d.node_id = far.node), "
    "es AS (SELECT * FROM tr WHERE NOT EXISTS (SELECT 1 FROM dp WHERE dp.repo_id = tr.repo_id AND dp.node_id = tr.node_id AND dp.c = tr.c)), "
    "ta AS (SELECT dn.repo_id, dn.node_id, direct, dn.k + count(es.c) AS blast_radius, count(es.c) AS escalation_count, coalesce(string_agg(es.c, ',' ORDER BY es.c), '') AS escalated FROM dn LEFT JOIN es USING (repo_id, node_id) GROUP BY dn.repo_id, dn.node_id, direct, dn.k), "
)
_ASY = (
    "ga AS (SELECT e.repo_id, e.edge_id, e.source, e.target, d.c FROM edges e JOIN dp d ON d.repo_id = e.repo_id AND d.node_id = e.target WHERE NOT EXISTS (SELECT 1 FROM dp s WHERE s.repo_id = e.repo_id AND s.node_id = e.source AND s.c = d.c)), "
    "asy AS (SELECT repo_id, edge_id, source, target, string_agg(c, ',' ORDER BY c) AS gained, CASE WHEN bool_or(c IN ('system_admin', 'execute_code')) THEN 'critical' WHEN bool_or(c IN ('write_data', 'database')) THEN 'high' ELSE 'medium' END AS risk_level FROM ga GROUP BY ALL), "
)
_UNU = "un AS (SELECT dp.repo_id, dp.node_id, coalesce(string_agg(dp.c, ',' ORDER BY dp.c) FILTER (up.c IS NULL), '') AS unused, count(up.c) / count(*) AS ut FROM dp LEFT JOIN up ON up.repo_id = dp.repo_id AND up.node_id = dp.node_id AND up.c = dp.c GROUP BY ALL), "
_DOM = _RZ + (
    "tx AS (SELECT DISTINCT repo_id, rs AS node_id, tool_name AS t FROM rz WHERE event_type = 'tool.invoked' AND rs <> '' UNION SELECT DISTINCT repo_id, accessor, state_key FROM ev WHERE event_type = 'state.access'), "
    f"tc AS (SELECT t, {s_classes('t', DATA_DOMAINS, 'generic')} AS cl FROM (SELECT DISTINCT t FROM tx)), "
    "nd0 AS (SELECT DISTINCT repo_id, node_id, d FROM (SELECT repo_id, node_id, unnest(cl) AS d FROM tx JOIN tc USING (t))), nd AS (SELECT n.repo_id, n.node_id, coalesce(d, 'generic') AS d FROM nodes n LEFT JOIN nd0 USING (repo_id, node_id)), "
    "fi AS (SELECT n.repo_id, n.node_id, count(DISTINCT e.edge_id) AS incoming_edges, count(DISTINCT nd.d) AS domain_count, coalesce(string_agg(DISTINCT nd.d, ',' ORDER BY nd.d), '') AS converging FROM nodes n LEFT JOIN edges e ON e.repo_id = n.repo_id AND e.target = n.node_id LEFT JOIN nd ON nd.repo_id = e.repo_id AND nd.node_id = e.source GROUP BY n.repo_id, n.node_id), "
    "xf AS (SELECT e.repo_id, e.edge_id, e.source, e.target, string_agg(t.d, ',' ORDER BY t.d) AS new_domains FROM edges e JOIN nd t ON t.repo_id = e.repo_id AND t.node_id = e.target WHERE NOT EXISTS (SELECT 1 FROM nd s WHERE s.repo_id = e.repo_id AND s.node_id = e.source AND s.d = t.d) GROUP BY ALL), "
)
_DEN = (
    "pd AS (SELECT repo_id, run_id, source_id AS node_id, count(*) FILTER (event_type = 'llm.call_end') AS l, count(*) FILTER (event_type = 'tool.completed') AS t, count(*) FILTER (event_type = 'delegation.initiated') AS d FROM ev WHERE event_type IN ('llm.call_end', 'tool.completed', 'delegation.initiated') AND source_id <> '' GROUP BY ALL), "
    "de AS (SELECT repo_id, node_id, avg(l) AS ml, avg(t) AS mt, avg(d) AS md, (avg(l) + avg(t)) / greatest(avg(d), 1) AS cd FROM pd GROUP BY ALL), "
    "pw AS (SELECT repo_id, run_id, source_id AS node_id, count(*) FILTER (event_type = 'error.occurred') AS er, count(*) FILTER (event_type = 'llm.call_end') AS ca, coalesce(sum(input_tokens), 0) AS pt FROM ev WHERE event_type IN ('llm.call_end', 'error.occurred') AND source_id <> '' GROUP BY ALL), "
    "rw AS (SELECT repo_id, node_id, avg(er) AS me, avg(ca) AS mc, sum(er) AS er, sum(ca) AS ca, avg(er) / greatest(avg(ca), 1) AS rr, CAST(floor(avg(er) * (sum(pt) / greatest(sum(ca), 1))) AS BIGINT) AS wt FROM pw GROUP BY ALL), "
)
_CHAIN = (
    "dl AS (SELECT repo_id, run_id, source_id AS s, target_id AS t, min(timestamp_ns) AS o FROM ev WHERE event_type = 'delegation.initiated' AND source_id <> '' AND target_id <> '' GROUP BY ALL), "
    "ch AS (SELECT DISTINCT repo_id, run_id, s AS root, [s] AS path FROM dl WHERE NOT EXISTS (SELECT 1 FROM dl x WHERE x.run_id = dl.run_id AND x.t = dl.s) UNION ALL "
    "SELECT c.repo_id, c.run_id, c.root, list_append(c.path, d.t) FROM ch c JOIN dl d ON d.run_id = c.run_id AND d.s = c.path[-1] AND NOT list_contains(c.path, d.t) AND d.o = (SELECT min(y.o) FROM dl y WHERE y.run_id = c.run_id AND y.s = c.path[-1] AND NOT list_contains(c.path, y.t))), "
    "cl AS (SELECT repo_id, run_id, root, arg_max(path, len(path)) AS path FROM ch GROUP BY ALL), tk AS (SELECT run_id, source_id AS node, sum(input_tokens + output_tokens) AS tok, arg_min(input_tokens, timestamp_ns) AS fi FROM ev WHERE event_type = 'llm.call_end' GROUP BY ALL), "
    "am AS (SELECT c.repo_id, c.run_id, c.root, len(path) AS chain_length, CAST(coalesce(sum(tok), 0) AS BIGINT) AS total_chain_tokens, coalesce(max(CASE WHEN tk.node = c.root THEN fi END), 0) AS first_node_input_tokens FROM cl c LEFT JOIN tk ON tk.run_id = c.run_id AND list_contains(c.path, tk.node) WHERE len(path) >= 2 GROUP BY ALL), "
    "ar AS (SELECT *, total_chain_tokens / greatest(first_node_input_tokens, 1) AS ratio FROM am), "
)
_CMP = (
    "ks AS (SELECT repo_id, run_id, k, key, bool_or(NOT en) AS s, bool_or(en) AS e FROM (SELECT repo_id, run_id, CASE WHEN event_type LIKE 'agent.task_%' THEN 'task' WHEN event_type LIKE 'delegation.%' THEN 'delegation' ELSE 'llm' END AS k, CASE WHEN event_type LIKE 'delegation.%' THEN delegation_id ELSE source_id END AS key, "
    "event_type IN ('agent.task_end', 'delegation.completed', 'llm.call_end') AS en FROM ev WHERE event_type IN ('agent.task_start', 'agent.task_end', 'delegation.initiated', 'delegation.completed', 'llm.call_start', 'llm.call_end')) GROUP BY ALL), "
    "kr AS (SELECT repo_id, run_id, k, count(*) FILTER (s AND e) / greatest(count(*) FILTER (s), 1) AS r, count(*) FILTER (s AND NOT e) AS os, count(*) FILTER (e AND NOT s) AS oe FROM ks GROUP BY ALL), rn AS (SELECT repo_id, count(DISTINCT run_id) AS n FROM ev GROUP BY 1), "
    "cm AS (SELECT repo_id, coalesce(sum(r) FILTER (k = 'task'), 0) / n AS t, coalesce(sum(r) FILTER (k = 'delegation'), 0) / n AS d, coalesce(sum(r) FILTER (k = 'llm'), 0) / n AS l, CAST(coalesce(sum(os), 0) AS BIGINT) AS os, CAST(coalesce(sum(oe), 0) AS BIGINT) AS oe FROM rn LEFT JOIN kr USING (repo_id) GROUP BY repo_id, n), "
)
_RV = "(contains({0}, 'review') OR contains({0}, 'validate') OR contains({0}, 'check') OR contains({0}, 'verify') OR contains({0}, 'audit') OR contains({0}, 'approve'))"
_SEP = (
    "wn AS (SELECT DISTINCT repo_id, node_id FROM dp WHERE c IN ('write_data', 'database')), dg AS (SELECT n.repo_id, n.node_id, (SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id AND e.source = n.node_id) AS o, (SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id AND e.target = n.node_id) AS i, "
    f"EXISTS (SELECT 1 FROM wn WHERE wn.repo_id = n.repo_id AND wn.node_id = n.node_id) AS w, EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = n.repo_id AND e.target = n.node_id AND {_RV.format('lower(e.source)')}) AS rv FROM nodes n), "
    f"sp AS (SELECT repo_id, count(*) FILTER ({_RV.format('lower(node_id)')} AND o + i > 0) AS sr, count(*) FILTER (w AND i > 0 AND NOT rv) AS uw, count(*) FILTER (i = 0 AND o > 0 AND w) AS sc FROM dg GROUP BY 1), "
    "ss AS (SELECT *, greatest(0, 1 - CASE WHEN sr > 0 THEN 0.3 ELSE 0 END - least(0.4, uw * 0.1) - least(0.4, sc * 0.2)) AS sco FROM sp), "
)
_TRC = "tc AS (SELECT repo_id, count(*) FILTER (event_type = 'routing.decision') AS rd, count(*) FILTER (preview IS NOT NULL) AS op, count(*) FILTER (event_type IN ('agent.task_end', 'llm.call_end', 'routing.decision')) AS dpn, bool_or(event_type = 'state.access') AS sa FROM ev GROUP BY 1), "
_FND = list(FINDING_REGULATIONS)
_FQ = "fq AS (SELECT repo_id, ids[u % 11 + 1] AS finding_id FROM (SELECT concat('repo_', user_id) AS repo_id, user_id AS u, " + repr(_FND) + " AS ids FROM users)), "


def reg_findings(c: Corpus):
    ids = F.array(*[F.lit(f) for f in _FND])
    return c.table("events").select("user_id").distinct().select(F.concat(F.lit("repo_"), "user_id").alias("repo_id"), F.get(ids, (F.col("user_id") % 11).cast("int")).alias("finding_id"))


def tools(c: Corpus):
    return X.tools_used(resolved(c), ["tool.invoked"])


def direct(c: Corpus):
    return c.keep("direct_permissions", lambda: X.direct_permissions(tools(c)))


def calls(c: Corpus):
    return X.tools_used(resolved(c), ["tool.completed"])


def domains(c: Corpus):
    return c.keep("node_domains", lambda: X.node_domains(c.nodes, tools(c), X.state_accesses(c.events)))


def seq(c: Corpus):
    return c.keep("state_sequences", lambda: K.sequences(c.events))


def errors(c: Corpus):
    return resolved(c).filter(F.col("event_type").startswith("error.")).groupBy("repo_id", F.col("source_node.node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("error_count"))


def joined(df, *cols):
    return df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


_ROLE = "coalesce(nullif(string_split({0}, ':')[2], ''), nullif({0}, ''), 'unknown')"
_MK = (
    f"st AS (SELECT repo_id, run_id, timestamp_ns, CAST(event_id AS VARCHAR) AS eid, CASE WHEN event_type = 'agent.task_start' THEN 'start:' || {_ROLE.format('source_id')} WHEN event_type = 'agent.task_end' AND status = 'success' THEN 'success:' || {_ROLE.format('source_id')} WHEN event_type = 'agent.task_end' THEN 'fail:' || {_ROLE.format('source_id')} "
    f"WHEN event_type = 'delegation.initiated' THEN 'delegate:' || {_ROLE.format('source_id')} || '→' || {_ROLE.format('target_id')} WHEN event_type LIKE 'error.%' THEN 'error:' || {_ROLE.format('source_id')} END AS state FROM ev), "
    "sq AS MATERIALIZED (SELECT *, lead(state) OVER (PARTITION BY run_id ORDER BY timestamp_ns, eid) AS nx FROM st WHERE state IS NOT NULL), cn AS MATERIALIZED (SELECT state, nx, count(*) AS n FROM sq WHERE nx IS NOT NULL GROUP BY ALL), "
    "sz AS MATERIALIZED (SELECT state, count(*) AS sc FROM sq GROUP BY 1), dn AS MATERIALIZED (SELECT state, coalesce((SELECT sum(n) FROM cn WHERE cn.state = sz.state), 0) + (SELECT count(*) FROM sz) AS den FROM sz), "
)
_V = "v0 AS (SELECT state, CAST(0 AS DOUBLE) AS v FROM sz), " + "".join(
    f"w{i} AS (SELECT state, CASE WHEN state LIKE 'error:%' OR state LIKE 'fail:%' THEN 1 ELSE v END AS w FROM v{i - 1}), "
    f"v{i} AS MATERIALIZED (SELECT dn.state, (coalesce((SELECT sum(n * w) FROM cn JOIN w{i} w ON w.state = cn.nx WHERE cn.state = dn.state), 0) + (SELECT sum(w) FROM w{i})) / den AS v FROM dn), " for i in range(1, 11))

QUERIES = [
    Query("j20_tool_permissions", lambda c: c.table("part").select("p_partkey", F.array_join(X.tool_permissions(F.concat_ws(" ", "p_name", "p_type")), ",").alias("permissions")), f"SELECT p_partkey, array_to_string({s_classes(chr(40) + 'p_name || ' + repr(' ') + ' || p_type' + chr(41), TOOL_PERMISSIONS, 'read_data')}, ',') AS permissions FROM part"),
    Query("j21_data_domains", lambda c: c.table("conversations").select("conv_id", "turn", F.array_join(X.data_domains(F.col("text")), ",").alias("domains")), f"SELECT conv_id, turn, array_to_string({s_classes('text', DATA_DOMAINS, 'generic')}, ',') AS domains FROM conversations"),
    Query("k1_direct_permissions", lambda c: joined(direct(c)), W("WITH " + _PERM.rstrip(", ") + " SELECT repo_id, node_id, direct FROM dn", "evl", "nodes")),
    Query("k2_transitive_permissions", lambda c: joined(X.transitive_permissions(direct(c), closure(c)).drop("effective")), W("WITH " + REACH + _TRANS.rstrip(", ") + " SELECT * FROM ta", "evl", "nodes", "edges", recursive=True)),
    Query("k2_escalation_paths", lambda c: X.escalation_paths(direct(c), closure(c)), W(
        "WITH " + REACH + _PERM.rstrip(", ") + " SELECT dn.repo_id, dn.node_id, d.c AS permission, arg_min(far.node, lpad(CAST(far.depth AS VARCHAR), 4, '0') || far.node) AS via FROM dn JOIN far ON far.repo_id = dn.repo_id AND far.origin = dn.node_id JOIN dp d ON d.repo_id = far.repo_id AND d.node_id = far.node "
        "WHERE NOT EXISTS (SELECT 1 FROM dp WHERE dp.repo_id = dn.repo_id AND dp.node_id = dn.node_id AND dp.c = d.c) GROUP BY dn.repo_id, dn.node_id, d.c", "evl", "nodes", "edges", recursive=True)),
    Query("k3_permission_asymmetries", lambda c: joined(X.asymmetries(direct(c), c.edges)), W("WITH " + _PERM + _ASY.rstrip(", ") + " SELECT * FROM asy", "evl", "nodes", "edges")),
    Query("k4_unused_permissions", lambda c: r6(joined(X.unused_permissions(direct(c), calls(c)))), W("WITH " + _PERM + _UNU.rstrip(", ") + " SELECT repo_id, node_id, unused, round(ut, 6) AS utilization_rate FROM un", "evl", "nodes")),
    Query("k5_permission_risk", lambda c: r6(X.permission_risk(direct(c), closure(c), c.edges, calls(c))), W(
        "WITH " + REACH + _TRANS + _ASY + _UNU + "t AS (SELECT repo_id, max(blast_radius) AS mb, sum(escalation_count) AS te FROM ta GROUP BY 1), a AS (SELECT repo_id, count(*) FILTER (risk_level = 'critical') AS ca FROM asy GROUP BY 1), u AS (SELECT repo_id, avg(ut) AS mu FROM un GROUP BY 1), "
        "z AS (SELECT t.repo_id, mb, te, coalesce(ca, 0) AS ca, mu, least(1, coalesce(ca, 0) * 0.3::DOUBLE + CAST(te AS DOUBLE) * 0.05::DOUBLE) AS s FROM t LEFT JOIN a USING (repo_id) JOIN u USING (repo_id)) SELECT repo_id, mb AS max_blast_radius, CAST(te AS BIGINT) AS total_escalation_count, ca AS critical_asymmetries, round(mu, 6) AS mean_utilization_rate, CAST(round(s, 6) AS DOUBLE) AS permission_risk_score, s > 0.3::DOUBLE AS finding_triggered FROM z", "evl", "nodes", "edges", recursive=True)),
    Query("k6_node_domains", lambda c: joined(domains(c)), W("WITH " + _DOM.rstrip(", ") + " SELECT repo_id, node_id, string_agg(d, ',' ORDER BY d) AS domains FROM nd GROUP BY ALL", "evl", "nodes", "edges")),
    Query("k7_fan_in", lambda c: joined(X.fan_in(domains(c), c.edges)), W("WITH " + _DOM.rstrip(", ") + " SELECT *, CASE WHEN domain_count >= 3 THEN 'high' WHEN domain_count = 2 THEN 'medium' ELSE 'low' END AS fan_in_risk FROM fi", "evl", "nodes", "edges")),
    Query("k8_cross_domain_flows", lambda c: joined(X.cross_domain_flows(domains(c), c.edges)), W("WITH " + _DOM.rstrip(", ") + " SELECT * FROM xf", "evl", "nodes", "edges")),
    Query("k9_privacy_exposure", lambda c: r6(X.privacy_exposure(domains(c), c.edges)), W(
        "WITH " + _DOM + "f AS (SELECT repo_id, count(*) FILTER (domain_count >= 3) AS h, max(domain_count) AS m FROM fi GROUP BY 1), x AS (SELECT repo_id, count(*) AS n FROM xf GROUP BY 1), z AS (SELECT repo_id, h, m, coalesce(n, 0) AS n, least(1, h * 0.2::DOUBLE + coalesce(n, 0) * 0.1::DOUBLE) AS s FROM f LEFT JOIN x USING (repo_id)) "
        "SELECT repo_id, h AS nodes_with_high_fan_in, m AS max_domain_convergence, n AS cross_domain_edges, CAST(round(s, 6) AS DOUBLE) AS privacy_exposure_score, s > 0.3::DOUBLE AS finding_triggered FROM z", "evl", "nodes", "edges")),
    Query("k10_token_chains", lambda c: r6(C.token_chains(c.events)), W("WITH " + _CHAIN.rstrip(", ") + " SELECT repo_id, run_id, root, chain_length, total_chain_tokens, first_node_input_tokens, round(ratio, 6) AS amplification_ratio FROM ar", "ev", recursive=True)),
    Query("k11_call_density", lambda c: r6(C.call_density(c.events)), W("WITH " + _DEN.rstrip(", ") + " SELECT repo_id, node_id, round(ml, 6) AS mean_llm_calls, round(mt, 6) AS mean_tool_calls, round(md, 6) AS mean_delegations, round(cd, 6) AS call_density FROM de", "ev")),
    Query("k12_retry_waste", lambda c: r6(C.retry_waste(c.events).drop("errors", "calls", "prompt")), W("WITH " + _DEN.rstrip(", ") + " SELECT repo_id, node_id, round(me, 6) AS mean_error_count, round(mc, 6) AS mean_total_calls, round(rr, 6) AS retry_rate, wt AS estimated_wasted_tokens FROM rw", "ev")),
    Query("k13_latency_profile", lambda c: r6(C.latency_profile(c.events)), W(
        "WITH p AS (SELECT repo_id, run_id, max(timestamp_ns) - min(timestamp_ns) AS s, coalesce(sum(latency_ms) FILTER (event_type = 'llm.call_end'), 0) AS m FROM ev GROUP BY ALL), a AS (SELECT repo_id, avg(s) / 1e9 AS s, avg(m) AS m FROM p GROUP BY 1), n AS (SELECT repo_id, source_id, avg(latency_ms) AS l, min(timestamp_ns) AS f FROM ev WHERE event_type = 'llm.call_end' GROUP BY ALL), "
        "b AS (SELECT repo_id, source_id AS bn, l AS bl FROM n QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY l DESC, f) = 1) SELECT repo_id, round(s, 6) AS mean_run_duration_seconds, round(least(1, greatest(0, (m / 1000) / greatest(s, 0.001))), 6) AS mean_llm_fraction, coalesce(bn, '') AS bottleneck_node, round(coalesce(bl, 0), 6) AS bottleneck_latency_ms FROM a LEFT JOIN b USING (repo_id)", "ev")),
    Query("k14_cost_risk", lambda c: r6(C.cost_risk(c.events)), W(
        "WITH " + _CHAIN + _DEN + "a AS (SELECT repo_id, max(ratio) AS mx, count(*) FILTER (ratio > 20) AS hc FROM ar GROUP BY 1), d AS (SELECT repo_id, count(*) FILTER (cd > 5) AS h, count(*) AS n FROM de GROUP BY 1), r AS (SELECT repo_id, sum(er) / greatest(sum(ca), 1) AS rr, sum(wt) AS w FROM rw GROUP BY 1), "
        "z AS (SELECT i.repo_id, coalesce(mx, 0) AS mx, coalesce(hc, 0) AS hc, coalesce(h, 0) AS h, coalesce(rr, 0) AS rr, CAST(coalesce(w, 0) AS BIGINT) AS w, least(1, coalesce(mx, 0) / 50) * 0.4 + least(1, coalesce(h, 0) / greatest(coalesce(n, 0), 1)) * 0.3 + least(1, coalesce(rr, 0) * 5) * 0.3 AS s FROM (SELECT DISTINCT repo_id FROM ev) i LEFT JOIN a USING (repo_id) LEFT JOIN d USING (repo_id) LEFT JOIN r USING (repo_id)) "
        "SELECT repo_id, round(mx, 6) AS max_amplification_ratio, hc AS high_amplification_chains, h AS high_density_nodes, round(rr, 6) AS corpus_retry_rate, w AS total_estimated_wasted_tokens, round(s, 6) AS cost_risk_score, s > 0.4 AS finding_triggered, round(mx * (1 + rr), 6) AS monthly_cost_multiplier FROM z", "ev", recursive=True)),
    Query("k21_completeness", lambda c: r6(A.completeness(c.events)), W("WITH " + _CMP.rstrip(", ") + " SELECT repo_id, round(t, 6) AS task_completion_rate, round(d, 6) AS delegation_completion_rate, round(l, 6) AS llm_completion_rate, os AS orphaned_starts, oe AS orphaned_ends, round((t + d + l) / 3, 6) AS overall_completeness FROM cm", "ev")),
    Query("k22_separation_of_duties", lambda c: r6(A.separation_of_duties(c.nodes, c.edges, direct(c))), W("WITH " + _PERM + _SEP.rstrip(", ") + " SELECT repo_id, sr AS self_review_nodes, uw AS unreviewed_write_nodes, sc AS single_points_of_control, CAST(round(sco, 6) AS DOUBLE) AS separation_score FROM ss", "evl", "nodes", "edges")),
    Query("k23_traceability", lambda c: r6(A.traceability(c.events)), W("WITH " + _TRC.rstrip(", ") + " SELECT repo_id, rd AS routing_decisions_logged, op AS outputs_with_preview, dpn AS total_decision_points, sa AS has_state_access_logging, round(op / greatest(dpn, 1), 6) AS traceability_fraction FROM tc", "ev")),
    Query("k24_regulations", lambda c: joined(A.regulations(reg_findings(c))).drop("requirements"), W(
        "WITH " + _FQ + "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{r}')" for f, rs in FINDING_REGULATIONS.items() for r in rs) + ") AS z(finding_id, fw)) SELECT repo_id, finding_id, coalesce(string_agg(fw, ',' ORDER BY fw), '') AS frameworks FROM fq LEFT JOIN m USING (finding_id) GROUP BY ALL", "users")),
    Query("k25_audit_readiness", lambda c: r6(A.audit_readiness(c.events, c.nodes, c.edges, direct(c), reg_findings(c))), W(
        "WITH " + _PERM + _SEP + _CMP + _TRC + _FQ + "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{r}')" for f, rs in FINDING_REGULATIONS.items() for r in rs) + ") AS z(finding_id, fw)), fr AS (SELECT repo_id, count(DISTINCT fw) AS k FROM fq JOIN m USING (finding_id) GROUP BY 1), "
        "z AS (SELECT cm.repo_id, (t + d + l) / 3 AS oc, sco, op / greatest(dpn, 1) AS tf, coalesce(k, 0) AS k FROM cm JOIN ss USING (repo_id) JOIN tc USING (repo_id) LEFT JOIN fr USING (repo_id)), y AS (SELECT *, greatest(0, least(1, oc * 0.3 + sco * 0.3 + tf * 0.25 + (1 - k / 5) * 0.15)) AS s FROM z) "
        "SELECT repo_id, round(oc, 6) AS overall_completeness, CAST(round(sco, 6) AS DOUBLE) AS separation_score, round(tf, 6) AS traceability_fraction, k AS frameworks_at_risk, round(s, 6) AS audit_readiness_score, s < 0.5 AS finding_triggered FROM y", "evl", "nodes", "edges")),
    Query("k27_downstream_reach", lambda c: closure(c).groupBy("repo_id", "origin").agg(F.count(F.lit(1)).alias("reach")), W("WITH " + REACH.rstrip(", ") + " SELECT repo_id, origin, count(*) AS reach FROM far GROUP BY ALL", "edges", recursive=True)),
    Query("k29_vulnerability", lambda c: r6(A.vulnerability(c.nodes, c.edges, closure(c), errors(c))), W(
        "WITH " + REACH + _RZ + "q AS (SELECT repo_id, rs, count(*) AS k FROM rz WHERE event_type LIKE 'error.%' GROUP BY ALL), g AS (SELECT n.repo_id, n.node_id, (SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id AND e.source = n.node_id) AS o, (SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id AND e.target = n.node_id) AS i, "
        "(SELECT count(*) FROM far WHERE far.repo_id = n.repo_id AND far.origin = n.node_id) AS r, coalesce((SELECT k FROM q WHERE q.repo_id = n.repo_id AND q.rs = n.node_id), 0) AS ec FROM nodes n), p AS (SELECT *, CASE WHEN i = 0 AND o > 0 THEN 'initial' WHEN i > 0 AND o = 0 THEN 'terminal' WHEN i > 0 AND o > 0 THEN 'intermediate' ELSE 'isolated' END AS pc FROM g), "
        "b AS (SELECT *, CASE WHEN pc = 'intermediate' THEN least(1, i * o / 28) ELSE 0 END AS bc FROM p), s AS (SELECT *, least(1, 0.3 * CASE pc WHEN 'terminal' THEN 1.5 WHEN 'initial' THEN 1.3 ELSE 1 END * CASE WHEN i > 1 THEN 1 + 0.2 * i ELSE 1 END * CASE WHEN r > 0 THEN 1 + 0.15 * r ELSE 1 END * (1 + 0.3 * bc)) AS raw FROM b) "
        "SELECT repo_id, node_id, o AS fan_out, i AS fan_in, r AS reach, ec AS error_count, pc AS position_class, round(bc, 6) AS betweenness, CAST(round(raw, 6) AS DOUBLE) AS raw_score, CAST(round(raw, 6) AS DOUBLE) AS vulnerability_score FROM s", "evl", "nodes", "edges", recursive=True)),
    Query("k32_state_sequences", lambda c: seq(c).select("run_id", "event_id", "state", "next_state"), W("WITH " + _MK.rstrip(", ") + " SELECT run_id, eid AS event_id, state, nx AS next_state FROM sq", "ev")),
    Query("k33_transitions", lambda c: r6(K.transitions(seq(c))), W("WITH " + _MK.rstrip(", ") + " SELECT state, nx AS next_state, n, round((n + 1) / den, 6) AS probability, round(1 / den, 6) AS unseen_probability FROM cn JOIN dn USING (state)", "ev")),
    Query("k34_violation_probability", lambda c: r6(c.keep("violation", lambda: K.violation_probability(seq(c)))), W("WITH " + _MK + _V.rstrip(", ") + " SELECT state, round(v, 6) AS probability FROM v10", "ev")),
    Query("k35_finding_probabilities", lambda c: r6(K.finding_probabilities(seq(c), c.keep("violation", lambda: K.violation_probability(seq(c))))), W(
        "WITH " + _MK + _V.rstrip(", ") + " SELECT round(sum(v * sc) / sum(sc), 6) AS mean_probability, round(max(v), 6) AS max_probability, round(min(v), 6) AS min_probability, round(sqrt(ln(2 / 0.05) / (2 * (SELECT count(DISTINCT run_id) FROM sq))), 6) AS confidence_bound FROM v10 JOIN sz USING (state) WHERE state LIKE 'start:%'", "ev")),
    Query("k36_top_transitions", lambda c: r6(K.top_transitions(K.transitions(seq(c))).drop("unseen_probability")), W("WITH " + _MK.rstrip(", ") + " SELECT state, nx AS next_state, n, round((n + 1) / den, 6) AS probability FROM cn JOIN dn USING (state) WHERE (n + 1) / den > 0.01 ORDER BY round((n + 1) / den, 9) DESC, state, nx LIMIT 20", "ev")),
    Query("k36_riskiest_states", lambda c: r6(K.riskiest_states(seq(c), K.transitions(seq(c)))), W(
        "WITH " + _MK + "z AS (SELECT dn.state, (coalesce((SELECT sum(n) FROM cn WHERE cn.state = dn.state AND (nx LIKE 'error:%' OR nx LIKE 'fail:%')), 0) + (SELECT count(*) FROM sz WHERE state LIKE 'error:%' OR state LIKE 'fail:%')) / den AS risk FROM dn WHERE NOT (state LIKE 'error:%' OR state LIKE 'fail:%')) SELECT state, round(risk, 6) AS risk FROM z ORDER BY round(risk, 9) DESC, state LIMIT 10", "ev")),
]

_BY_NAME = {q.name: q for q in QUERIES}
_PART = "(SELECT repo_id, {1} FROM ({0})) AS {2}"
QUERIES.append(Query(
    "k31_all_scores", lambda c: r6(A.all_scores(X.permission_risk(direct(c), closure(c), c.edges, calls(c)), X.privacy_exposure(domains(c), c.edges), C.cost_risk(c.events), A.audit_readiness(c.events, c.nodes, c.edges, direct(c), reg_findings(c)))),
    "SELECT repo_id, permission_risk_score, privacy_exposure_score, cost_risk_score, audit_readiness_score FROM " + " FULL JOIN ".join(
        _PART.format(_BY_NAME[n].sql, col, f"p{i}") + (" USING (repo_id)" if i else "") for i, (n, col) in enumerate((("k5_permission_risk", "permission_risk_score"), ("k9_privacy_exposure", "privacy_exposure_score"), ("k14_cost_risk", "cost_risk_score"), ("k25_audit_readiness", "audit_readiness_score"))))))
