"""Registered queries: error traces, failure modes, baselines, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.constants import FINDING_NAMES, METRICS, PRECONDITION_FINDING, RUNTIME_FINDINGS
from spoor.operators import baselines as B
from spoor.operators import failure as X
from spoor.operators import graph as G
from spoor.operators import lineage as L
from spoor.operators import propagation as P
from spoor.operators import actual_paths as T
from spoor.operators import resolve as D
from spoor.plans.corpus import Corpus, Query, r6
from spoor.plans.q_overlay import EVR, REACH, REFMAP, ref_map
from spoor.sources.inline import values
from spoor.sources.tables import with_ctes as W


def order(c: Corpus):
    return c.keep("breadth_first", lambda: G.breadth_first(c.edges))


def actual(c: Corpus):
    return c.keep("actual_traces", lambda: T.actual_traces(c.events))


def traces(c: Corpus):
    return c.keep("error_traces", lambda: P.trace_errors(c.events, c.nodes, order(c)))


def findings(c: Corpus):
    """Findings that belong to the declared preconditions of a repository."""
    m = values(c.spark, list(PRECONDITION_FINDING.items()), ["precondition", "finding_id"])
    return c.preconditions.join(F.broadcast(m), "precondition").select("repo_id", "finding_id").distinct()


def resolved(c: Corpus):
    return c.keep("resolved_events", lambda: D.resolved_ids(c.events, ref_map(c)))


def handoffs(c: Corpus):
    return c.keep("handoffs", lambda: L.handoffs(resolved(c), c.nodes, c.edges))


_WH = "coalesce(CASE WHEN event_type = 'state.access' THEN src_struct END, nullif(source_id, ''), nullif(source_name, ''))"
_TR = (
    "x AS (SELECT *, CAST(event_id AS VARCHAR) AS eid, " + _WH + " AS wh FROM ev), "
    "nm AS (SELECT repo_id, ref, arg_max(node_id, node_ord) AS sid FROM (SELECT repo_id, node_ord, node_id, node_id AS ref FROM nodes UNION ALL SELECT repo_id, node_ord, node_id, name FROM nodes) GROUP BY ALL), "
    "rs AS (SELECT r.repo_id, r.ref, coalesce(a.sid, b.sid) AS sid FROM (SELECT DISTINCT repo_id, wh AS ref FROM x WHERE wh IS NOT NULL UNION SELECT DISTINCT repo_id, source_name FROM x WHERE source_name <> '') r "
    "LEFT JOIN nm a ON a.repo_id = r.repo_id AND a.ref = r.ref LEFT JOIN nm b ON b.repo_id = r.repo_id AND b.ref = string_split(r.ref, ':')[2]), "
    "sd AS (SELECT x.*, rs.sid AS ssid FROM x LEFT JOIN rs ON rs.repo_id = x.repo_id AND rs.ref = x.wh WHERE (event_type LIKE 'error.%' OR (event_type = 'agent.task_end' AND status = 'error')) AND wh IS NOT NULL), "
    "act AS (SELECT * FROM x WHERE event_type IN ('agent.task_start', 'agent.task_end', 'error.occurred', 'error.propagated')), "
    "h1 AS (SELECT s.repo_id, s.run_id, s.eid, a.wh AS node, min(a.timestamp_ns) AS k FROM sd s JOIN act a ON a.run_id = s.run_id AND a.timestamp_ns > s.timestamp_ns AND a.wh <> s.wh AND (a.event_type LIKE 'error.%' OR a.status = 'error') GROUP BY ALL), "
    "ac AS (SELECT DISTINCT s.eid, s.repo_id, rs.sid AS node, s.ssid FROM sd s JOIN act a ON a.run_id = s.run_id AND a.timestamp_ns > s.timestamp_ns JOIN rs ON rs.repo_id = s.repo_id AND rs.ref IN (a.wh, a.source_name) WHERE s.ssid IS NOT NULL AND rs.sid IS NOT NULL), "
    "h2 AS (SELECT ac.eid, ac.node, far.depth FROM ac JOIN far ON far.repo_id = ac.repo_id AND far.origin = ac.ssid AND far.node = ac.node WHERE NOT EXISTS (SELECT 1 FROM h1 JOIN rs ON rs.repo_id = h1.repo_id AND rs.ref = h1.node WHERE h1.eid = ac.eid AND rs.sid = ac.node)), "
    "n1 AS (SELECT eid, count(*) AS n, arg_max(node, k) AS last FROM h1 GROUP BY eid), n2 AS (SELECT eid, count(*) AS n FROM h2 GROUP BY eid), "
    "lt AS (SELECT s.eid, count(*) FILTER (b.event_type LIKE 'error.%') AS de, count(*) FILTER (b.event_type = 'agent.task_end' AND b.status = 'error') AS df FROM sd s JOIN x b ON b.run_id = s.run_id AND b.timestamp_ns > s.timestamp_ns GROUP BY s.eid) "
)
_DEPTH = (
    "dd AS (SELECT repo_id, run_id, timestamp_ns, CAST(event_id AS VARCHAR) AS eid, CASE WHEN event_type = 'agent.task_end' THEN -1 ELSE 1 END AS d FROM ev WHERE event_type IN ('delegation.initiated', 'agent.task_end') OR (event_type = 'agent.task_start' AND parent_node IS NOT NULL)), "
    "cu AS (SELECT *, sum(d) OVER w AS cum FROM dd WINDOW w AS (PARTITION BY run_id ORDER BY timestamp_ns, eid)), "
    "mx AS (SELECT repo_id, run_id, CAST(max(cum - least(0, low)) AS BIGINT) AS max_depth FROM (SELECT *, min(cum) OVER (PARTITION BY run_id ORDER BY timestamp_ns, eid) AS low FROM cu) GROUP BY ALL), "
)
_BADEND = "(event_type IN ('agent.task_end', 'tool.completed') AND status = 'error')"
_SW = (
    f"se AS (SELECT *, CAST(event_id AS VARCHAR) AS eid, coalesce(nullif(source_id, ''), CASE WHEN event_type = 'state.access' THEN src_struct END) AS nd FROM ev), "
    f"fs AS (SELECT repo_id, run_id, nd, timestamp_ns, eid FROM se WHERE (event_type IN ('error.occurred', 'error.propagated') OR {_BADEND}) QUALIFY nd IS NULL OR row_number() OVER (PARTITION BY run_id, nd ORDER BY timestamp_ns, eid) = 1), "
    f"sf AS (SELECT f.repo_id, f.run_id, f.eid, f.nd, count(*) FILTER (b.event_type IN ('error.occurred', 'error.propagated') OR {_BADEND.replace('event_type', 'b.event_type').replace('status', 'b.status')}) AS le, count(*) FILTER (b.event_type = 'agent.task_end' AND b.status = 'error') AS lf, "
    "count(*) FILTER (b.event_type = 'agent.task_end' AND b.status = 'success') AS lo FROM fs f LEFT JOIN se b ON b.run_id = f.run_id AND (b.timestamp_ns > f.timestamp_ns OR (b.timestamp_ns = f.timestamp_ns AND b.eid > f.eid)) GROUP BY ALL), "
)
_SILENT = "error_handling IN ('caught_silent', 'caught_default', 'fail_silent')"
# after REACH and _TR: sp (repo_id, eid, error_type, alone, how, hurt), how each error seed ended; the last node is the last silent one by breadth-first order, else the last to err
_STOP = (
    "bf AS (SELECT repo_id, source AS origin, target AS node, 1 AS depth, [min(edge_ord)] AS via FROM edges WHERE source <> target GROUP BY ALL UNION ALL SELECT repo_id, origin, node, depth, min(via) FROM ("
    "SELECT b.repo_id, b.origin, e.target AS node, b.depth + 1 AS depth, list_append(b.via, e.edge_ord) AS via FROM bf b JOIN edges e ON e.repo_id = b.repo_id AND e.source = b.node WHERE b.depth < 8 AND e.target <> b.origin) GROUP BY ALL), "
    "vi AS (SELECT repo_id, origin, node, arg_min(via, depth) AS via FROM bf GROUP BY ALL), l1 AS (SELECT eid, arg_max(node, struct_pack(k := k, n := node)) AS node FROM h1 GROUP BY eid), "
    "l2 AS (SELECT h2.eid, arg_max(h2.node, struct_pack(d := h2.depth, v := vi.via, n := h2.node)) AS node FROM h2 JOIN sd USING (eid) JOIN vi ON vi.repo_id = sd.repo_id AND vi.origin = sd.ssid AND vi.node = h2.node GROUP BY h2.eid), "
    "la AS (SELECT sd.repo_id, sd.run_id, sd.eid, sd.timestamp_ns, sd.error_type, coalesce(l2.node, l1.node) AS node FROM sd LEFT JOIN l1 USING (eid) LEFT JOIN l2 USING (eid)), "
    "hd AS (SELECT run_id, wh, timestamp_ns, CASE WHEN error_handling IN ('retry', 'caught_retry') THEN 'retry' WHEN error_handling IN ('caught_silent', 'caught_default') THEN 'error_handler' WHEN event_type = 'guardrail.triggered' THEN 'guardrail' END AS how FROM x), "
    "ho AS (SELECT la.eid, arg_min(hd.how, hd.timestamp_ns) AS how FROM la JOIN hd ON hd.run_id = la.run_id AND hd.wh = la.node AND hd.timestamp_ns > la.timestamp_ns WHERE hd.how IS NOT NULL GROUP BY la.eid), "
    "sp AS MATERIALIZED (SELECT la.repo_id, la.eid, error_type, la.node IS NULL AS alone, how, coalesce(de, 0) > 0 AS hurt FROM la LEFT JOIN ho USING (eid) LEFT JOIN lt USING (eid)), "
)
_WR = (
    "wr AS (SELECT repo_id, run_id, coalesce(nullif(target_name, ''), state_key, 'default') AS ky, coalesce(nullif(target_name, ''), state_key) AS ky0, coalesce(nullif(source_name, ''), CASE WHEN event_type = 'state.access' THEN src_struct END) AS w FROM ev "
    "WHERE event_type IN ('data.write', 'state.access') AND coalesce(access_type, '') IN ('write', 'read_write', '')), "
)
_MET = _WR + (
    "cf AS (SELECT run_id, sum(n) FILTER (ws >= 2) / sum(n) AS rate FROM (SELECT run_id, ky, count(*) AS n, count(DISTINCT w) AS ws FROM wr GROUP BY ALL) GROUP BY run_id), "
    "dl AS (SELECT e.run_id, (e.timestamp_ns - s.timestamp_ns) / 1e6 AS ms FROM evl e JOIN evl s ON e.run_id = s.run_id AND e.parent_id = s.event_id AND s.event_type = 'delegation.initiated' WHERE e.event_type = 'delegation.completed' AND e.timestamp_ns >= s.timestamp_ns), "
    "p95 AS (SELECT run_id, list_sort(list(ms))[least(CAST(floor(count(*) * 0.95) AS BIGINT) + 1, count(*))] AS v FROM dl GROUP BY run_id), "
    "met AS (SELECT repo_id, run_id, CAST(count(*) FILTER (event_type = 'delegation.initiated') AS DOUBLE) AS max_delegation_depth, "
    f"count(*) FILTER (event_type LIKE 'error.%' AND {_SILENT}) / greatest(count(*) FILTER (event_type LIKE 'error.%'), 1) AS error_swallow_rate, CAST(count(*) FILTER (event_type = 'llm.call_start') AS DOUBLE) AS total_llm_calls_per_run, "
    "CASE WHEN count(*) FILTER (event_type = 'agent.task_end') > 0 THEN least(count(*) FILTER (event_type LIKE 'error.%' AND error_type = 'schema_mismatch') / greatest(count(*) FILTER (event_type = 'agent.task_end'), 1), 1) ELSE 0 END AS schema_mismatch_rate, "
    "count(*) FILTER (event_type = 'tool.call_failure') / greatest(count(*) FILTER (event_type IN ('tool.completed', 'tool.call_failure')), 1) AS tool_call_failure_rate, "
    "coalesce(any_value(cf.rate), 0) AS concurrent_state_write_rate, coalesce(any_value(p95.v), 0) AS delegation_latency_p95_ms FROM evl LEFT JOIN cf USING (run_id) LEFT JOIN p95 USING (run_id) GROUP BY repo_id, run_id), "
)
_MCOLS = ["max_delegation_depth", "error_swallow_rate", "total_llm_calls_per_run", "concurrent_state_write_rate", "schema_mismatch_rate", "tool_call_failure_rate", "delegation_latency_p95_ms"]
_UNPIV = "lg AS (" + " UNION ALL ".join(f"SELECT repo_id, '{m}' AS metric, {m} AS v FROM met" for m in _MCOLS) + "), "
_SPEC = "sp AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{f}', '{u}', {str(cap).lower()}, '{sc}')" for m, (f, u, cap, sc) in METRICS.items()) + ") AS z(metric, finding_id, unit, cap, scanner_metric)) "
_HO = REFMAP + EVR + (
    "rz AS (SELECT *, coalesce(src, source_id) AS rs, coalesce(tgt, target_id) AS rt FROM evr), ou AS (SELECT * FROM rz WHERE output_hash IS NOT NULL), "
    "fo AS (SELECT repo_id, rs, min(timestamp_ns) AS f FROM ou GROUP BY ALL), mk AS (SELECT ou.repo_id, ou.run_id, ou.output_hash, arg_max(ou.rs, fo.f) AS pr FROM ou JOIN fo ON fo.repo_id = ou.repo_id AND fo.rs = ou.rs GROUP BY ALL), "
    "ho AS (SELECT i.repo_id, i.run_id, i.event_id, coalesce(context_source, nullif(pr, '')) AS source, rt AS target, context_hash AS content_hash, class_dependency AS cd, EXISTS (SELECT 1 FROM edges a JOIN edges b ON a.repo_id = b.repo_id AND a.target = b.source AND a.target = 'guard_input_12' "
    "WHERE a.repo_id = i.repo_id AND a.source = coalesce(context_source, pr) AND b.target = rt) AS validated FROM rz i LEFT JOIN mk ON mk.run_id = i.run_id AND mk.output_hash = i.context_hash WHERE i.context_hash IS NOT NULL AND coalesce(context_source, nullif(pr, '')) IS NOT NULL), "
)
_HREACH = _HO + (
    "ha AS MATERIALIZED (SELECT DISTINCT repo_id, source, target FROM ho WHERE source <> '' AND target <> ''), "
    "hw AS (SELECT repo_id, source AS origin, target AS node, 1 AS depth FROM ha WHERE source <> target UNION SELECT w.repo_id, w.origin, e.target, w.depth + 1 FROM hw w JOIN ha e ON e.repo_id = w.repo_id AND e.source = w.node WHERE w.depth < 11 AND e.target <> w.origin), "
    "br AS (SELECT repo_id, origin, count(DISTINCT node) AS blast_radius FROM hw GROUP BY ALL) "
)
_FMAP = "fm AS (SELECT DISTINCT repo_id, finding_id FROM pre JOIN (VALUES " + ", ".join(f"('{p}', '{f}')" for p, f in PRECONDITION_FINDING.items()) + ") AS q(precondition, finding_id) USING (precondition)), "
_RF = "rf AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{FINDING_NAMES[f]}', '{t}')" for f, t in RUNTIME_FINDINGS.items()) + ") AS z(finding_id, finding_name, failure_type)), "

_PAY = (
    "WITH " + _DEPTH + "q AS (SELECT run_id, list_sort(list(latency_ms))[least(CAST(floor(count(*) * 0.95) AS BIGINT) + 1, count(*))] AS v FROM ev WHERE event_type = 'delegation.initiated' AND latency_ms IS NOT NULL GROUP BY run_id), "
    "sw AS (SELECT run_id, state_key, count(DISTINCT accessor) AS w, count(*) AS n FROM ev WHERE access_type = 'write' GROUP BY ALL), s2 AS (SELECT run_id, count(*) FILTER (w > 1) / sum(n) AS r FROM sw GROUP BY run_id), "
    "eo AS (SELECT run_id, timestamp_ns, event_id FROM ev WHERE event_type = 'error.occurred'), "
    f"e2 AS (SELECT o.run_id, o.event_id, count(*) FILTER (b.event_type IN ('error.occurred', 'error.propagated') OR (b.event_type IN ('agent.task_end', 'tool.completed') AND b.status = 'error')) AS le, count(*) FILTER (b.event_type = 'agent.task_end' AND b.status = 'success') AS lo FROM eo o LEFT JOIN ev b ON b.run_id = o.run_id AND b.timestamp_ns > o.timestamp_ns GROUP BY ALL), "
    "e3 AS (SELECT run_id, count(*) FILTER (le = 0 AND lo > 0) / count(*) AS r FROM e2 GROUP BY run_id), "
    "b AS (SELECT repo_id, run_id, count(*) FILTER (event_type IN ('llm.call_start', 'llm.call_end')) AS lb, count(*) FILTER (event_type = 'llm.call_end') AS le FROM ev GROUP BY ALL) "
    "SELECT b.repo_id, b.run_id, CAST(CASE WHEN lb // 2 > 0 THEN lb // 2 ELSE le END AS DOUBLE) AS total_llm_calls_per_run, CAST(0 AS DOUBLE) AS tool_call_failure_rate, CAST(0 AS DOUBLE) AS schema_mismatch_rate, CAST(coalesce(max_depth, 0) AS DOUBLE) AS max_delegation_depth, "
    "round(coalesce(e3.r, 0), 6) AS error_swallow_rate, round(coalesce(s2.r, 0), 6) AS concurrent_state_write_rate, round(q.v, 6) AS delegation_latency_p95_ms FROM b LEFT JOIN mx USING (run_id) LEFT JOIN q USING (run_id) LEFT JOIN s2 USING (run_id) LEFT JOIN e3 USING (run_id)"
)

_ACTUAL = (
    "er AS MATERIALIZED (SELECT repo_id, run_id, CAST(event_id AS VARCHAR) AS eid, timestamp_ns, nullif(source_id, '') AS node, row_number() OVER (PARTITION BY run_id ORDER BY timestamp_ns, CAST(event_id AS VARCHAR)) AS place, event_type IN ('error.occurred', 'error.propagated') OR status = 'error' AS seedable FROM ev "
    "WHERE event_type IN ('error.occurred', 'error.propagated') OR (event_type IN ('agent.task_end', 'tool.completed') AND status IN ('failed', 'error'))), "
    "sd AS MATERIALIZED (SELECT * FROM er WHERE seedable AND node IS NULL UNION ALL SELECT * FROM er WHERE seedable AND node IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, node ORDER BY place) = 1), "
    "rc AS (SELECT s.run_id, s.eid, e.node, min(e.place) AS k FROM sd s JOIN er e ON e.run_id = s.run_id AND e.place > s.place AND e.node IS NOT NULL AND (s.node IS NULL OR e.node <> s.node) GROUP BY ALL), "
    "pa AS MATERIALIZED (SELECT sd.repo_id, sd.run_id, sd.eid, sd.timestamp_ns, sd.node AS source, CASE WHEN any_value(sd.node) IS NULL THEN [] ELSE [any_value(sd.node)] END || coalesce(list(rc.node ORDER BY k) FILTER (rc.node IS NOT NULL), []) AS path FROM sd LEFT JOIN rc USING (run_id, eid) GROUP BY ALL), "
    "la AS (SELECT p.run_id, p.eid, count(*) FILTER (event_type = 'agent.task_end' AND status = 'success') AS oks, arg_min(coalesce(event_type = 'agent.task_end' AND status = 'success', false), struct_pack(t := e.timestamp_ns, e := CAST(e.event_id AS VARCHAR))) AS first_ok FROM pa p JOIN ev e ON e.run_id = p.run_id AND e.source_id = p.path[-1] AND (e.timestamp_ns, CAST(e.event_id AS VARCHAR)) > (p.timestamp_ns, p.eid) GROUP BY ALL), "
    "atr AS (SELECT pa.*, CASE WHEN len(path) = 0 THEN 'no_propagation' WHEN (contains(lower(path[-1]), 'guard') OR contains(lower(path[-1]), 'review')) AND first_ok = false THEN 'error_boundary' WHEN coalesce(oks, 0) > 0 THEN 'retry_succeeded' ELSE 'end_of_chain' END AS stop_mechanism FROM pa LEFT JOIN la USING (run_id, eid)), "
)
G19 = W(
    "WITH " + _DEPTH + _SW + "pr AS (SELECT repo_id, run_id, bool_or((contains(lower(source_name), 'guard') OR contains(lower(source_name), 'review') OR contains(lower(source_name), 'human')) AND event_type <> 'error.occurred') AS g FROM ev GROUP BY ALL), "
    "r AS (SELECT repo_id, count(*) FILTER (NOT g) AS no_human_gate_activation, count(*) AS nr FROM pr GROUP BY ALL), dv AS (SELECT repo_id, count(*) AS k FROM (SELECT repo_id, source_id FROM ev WHERE output_hash IS NOT NULL AND source_id <> '' GROUP BY ALL HAVING count(DISTINCT output_hash) > 1) GROUP BY ALL), "
    "f1 AS (SELECT repo_id, min(run_id) AS run_id FROM ev GROUP BY repo_id), tu AS (SELECT repo_id, run_id, tool_node FROM ev WHERE tool_node IS NOT NULL), un AS (SELECT t.repo_id, count(*) AS k FROM tu t JOIN f1 USING (repo_id) WHERE t.run_id <> f1.run_id AND NOT EXISTS (SELECT 1 FROM tu u WHERE u.run_id = f1.run_id AND u.tool_node = t.tool_node) GROUP BY ALL), "
    "sw AS (SELECT repo_id, run_id, state_key, count(DISTINCT accessor) AS w, count(*) AS n FROM ev WHERE access_type = 'write' GROUP BY ALL), ss AS (SELECT repo_id, count(*) FILTER (w > 1) AS c1, count(*) FILTER (n > 1) AS c2 FROM sw GROUP BY ALL), "
    "dp AS (SELECT repo_id, count(*) FILTER (max_depth >= 3) AS k FROM mx GROUP BY ALL), s1 AS (SELECT repo_id, count(*) FILTER (le = 0 AND lo > 0) AS k FROM sf GROUP BY ALL) "
    "SELECT repo_id, no_human_gate_activation, CAST(0 AS BIGINT) AS tool_call_failure, CAST(0 AS BIGINT) AS api_timeout, coalesce(dp.k, 0) AS delegation_depth, coalesce(s1.k, 0) AS error_swallowed, CASE WHEN nr >= 2 THEN coalesce(dv.k, 0) ELSE 0 END AS output_divergence, "
    "coalesce(un.k, 0) AS unexpected_tool_usage, coalesce(c1, 0) AS concurrent_state_writes, coalesce(c2, 0) AS state_overwrite FROM r LEFT JOIN dv USING (repo_id) LEFT JOIN un USING (repo_id) LEFT JOIN ss USING (repo_id) LEFT JOIN dp USING (repo_id) LEFT JOIN s1 USING (repo_id)", "ev")
_TALL = " UNION ALL ".join(f"SELECT repo_id, '{f}' AS finding_id, '{n}' AS finding_name, '{t}' AS failure_type, {i} AS o, '{g}' AS signal, {'error_swallowed' if g == 'silent_error_handling' else g} AS n FROM sg" for f, (n, t, names) in T.SCRIPT_FINDINGS.items() for i, g in enumerate(names))
G18 = (
    f"WITH sg AS MATERIALIZED ({G19}), tl AS ({_TALL}), fs AS (SELECT repo_id, finding_id, finding_name, failure_type, CAST(sum(n) AS BIGINT) AS occurrences, string_agg(signal, ', ' ORDER BY o) FILTER (n > 0) AS seen FROM tl GROUP BY ALL) "
    "SELECT repo_id, finding_id, finding_name, failure_type, occurrences > 0 AS manifestation_observed, occurrences, occurrences > 0 AS downstream_impact, CASE WHEN occurrences > 0 THEN 'Seen ' || occurrences || ' times: ' || seen END AS failure_description FROM fs")

QUERIES = [
    Query("g1_error_traces", lambda c: traces(c).select("repo_id", "run_id", "event_id", "error_source_node", "error_type", "nodes_affected", "downstream_errors", "downstream_tasks_failed", "swallowed", F.size("predicted_path").alias("predicted_nodes")), W(
        "WITH " + REACH + _TR + "SELECT s.repo_id, s.run_id, s.eid AS event_id, s.wh AS error_source_node, coalesce(s.error_type, 'unknown') AS error_type, CAST(coalesce(n1.n, 0) + coalesce(n2.n, 0) AS BIGINT) AS nodes_affected, coalesce(de, 0) AS downstream_errors, "
        "coalesce(df, 0) AS downstream_tasks_failed, coalesce(n1.n, 0) + coalesce(n2.n, 0) = 0 AS swallowed, 1 + (SELECT count(*) FROM far WHERE far.repo_id = s.repo_id AND far.origin = coalesce(s.ssid, s.wh)) AS predicted_nodes "
        "FROM sd s LEFT JOIN n1 USING (eid) LEFT JOIN n2 USING (eid) LEFT JOIN lt USING (eid)", "ev", "nodes", "edges", recursive=True)),
    Query("g2_structural_downstream", lambda c: order(c).select("repo_id", "origin", "node", "depth"), W("WITH " + REACH.rstrip(", ") + " SELECT repo_id, origin, node, depth FROM far", "edges", recursive=True)),
    Query("g4_stop_mechanisms", lambda c: traces(c).select("repo_id", "run_id", "event_id", "propagation_stopped_by", "stop_mechanism", "structural_prediction_match")),
    Query("g7_g11_g12_g13_first_seeds", lambda c: P.swallow_flags(c.events), W("WITH " + _SW.rstrip(", ") + " SELECT repo_id, run_id, eid AS event_id, nd AS node, le AS later_errors, lf AS later_failed, (le = 0 AND lo > 0) AS swallowed FROM sf", "ev")),
    Query("g14_failure_modes", lambda c: X.failure_modes(findings(c), c.events, traces(c)), W(
        "WITH " + _FMAP + _RF + _WR + REACH + _TR + ", " + _STOP + f"sg AS (SELECT repo_id, count(*) FILTER (event_type = 'delegation.initiated') AS dn, bool_or(event_type LIKE 'error.%' AND {_SILENT}) AS si FROM ev GROUP BY ALL), "
        "al AS (SELECT * FROM fm UNION SELECT repo_id, 'STRAT-DC-001' FROM sg WHERE dn >= 3 UNION SELECT repo_id, 'STRAT-SI-001' FROM sg WHERE si), ah AS (SELECT repo_id, bool_or(hurt) AS hurt FROM sp GROUP BY ALL), "
        "oc AS (SELECT repo_id, 'STRAT-DC-001' AS finding_id, 'delegation_depth_>=3' AS signal, 1 AS n, coalesce(hurt, false) AS hurt FROM sg LEFT JOIN ah USING (repo_id) WHERE dn >= 3 UNION ALL SELECT repo_id, 'STRAT-DC-001', 'no_human_gate_activation', 1, false FROM sg WHERE dn > 0 UNION ALL "
        "SELECT repo_id, 'STRAT-SI-001', 'error_swallowed', count(*), bool_or(hurt) FROM sp WHERE alone OR how = 'error_handler' GROUP BY ALL UNION ALL "
        f"SELECT repo_id, 'STRAT-SI-001', 'silent_error_handling', count(*), false FROM ev WHERE event_type LIKE 'error.%' AND {_SILENT} GROUP BY ALL UNION ALL "
        "SELECT repo_id, 'STRAT-SI-004', 'schema_mismatch_error', count(*), bool_or(hurt) FROM sp WHERE error_type = 'schema_mismatch' GROUP BY ALL UNION ALL "
        "SELECT repo_id, 'STRAT-OC-002', 'concurrent_state_writes', count(*), true FROM (SELECT repo_id, ky0 FROM wr WHERE ky0 IS NOT NULL GROUP BY ALL HAVING count(DISTINCT w) >= 2) GROUP BY ALL), "
        "ag AS (SELECT repo_id, finding_id, CAST(sum(n) AS BIGINT) AS n, bool_or(hurt) AS hurt, string_agg(signal, ', ' ORDER BY signal) AS s FROM oc GROUP BY ALL) "
        "SELECT al.repo_id, al.finding_id, finding_name, failure_type, coalesce(n, 0) AS occurrences, n IS NOT NULL AS manifestation_observed, coalesce(hurt, false) AS downstream_impact_observed, "
        "CASE WHEN n IS NULL THEN 'No behavioral manifestation observed' ELSE concat('Observed ', n, ' instances across signals: ', s) END AS failure_description "
        "FROM al JOIN rf USING (finding_id) LEFT JOIN ag USING (repo_id, finding_id)", "ev", "pre", "nodes", "edges", recursive=True)),
    Query("g14_silent_failure_modes", lambda c: X.failure_modes(findings(c), c.events, traces(c)).filter("finding_id = 'STRAT-SI-001'")),
    Query("g14_failure_examples", lambda c: X.examples(X.signal_occurrences(c.events, traces(c))).groupBy("repo_id", "finding_id").agg(F.count(F.lit(1)).alias("shown"))),
    Query("g15_suggested_findings", lambda c: X.suggested(c.events), W(
        f"SELECT repo_id, 'STRAT-SI-001' AS finding_id FROM ev GROUP BY repo_id HAVING bool_or(event_type LIKE 'error.%' AND {_SILENT}) UNION ALL SELECT repo_id, 'STRAT-DC-001' FROM ev GROUP BY repo_id HAVING count(*) FILTER (event_type = 'delegation.initiated') >= 3", "ev")),
    Query("g9_actual_paths", lambda c: actual(c).select("repo_id", "run_id", "event_id", "source", F.array_join("actual_path", "->").alias("path"), "stop_mechanism"), W(
        "WITH " + _ACTUAL.rstrip(", ") + " SELECT repo_id, run_id, eid AS event_id, source, array_to_string(path, '->') AS path, stop_mechanism FROM atr", "ev")),
    Query("g9_path_steps", lambda c: T.path_steps(c.events), W(
        "WITH " + _ACTUAL + "sp AS (SELECT repo_id, run_id, eid AS event_id, source, unnest(path) AS node, generate_subscripts(path, 1) AS i FROM pa) SELECT repo_id, run_id, event_id, CAST(CASE WHEN source IS NULL THEN i ELSE i - 1 END AS INTEGER) AS step, node FROM sp", "ev")),
    Query("g10_stop_census", lambda c: actual(c).groupBy("repo_id", "stop_mechanism").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("actual_path")).alias("mean_length")).select("repo_id", "stop_mechanism", "n", F.round("mean_length", 6).alias("mean_length")), W(
        "WITH " + _ACTUAL.rstrip(", ") + " SELECT repo_id, stop_mechanism, count(*) AS n, round(avg(len(path)), 6) AS mean_length FROM atr GROUP BY ALL", "ev")),
    Query("g18_script_findings", lambda c: T.script_failure_modes(X.run_signals(c.events)), G18),
    Query("g19_run_signals", lambda c: X.run_signals(c.events), G19),
    Query("g20_running_depth", lambda c: P.running_depth(c.events), W("WITH " + _DEPTH.rstrip(", ") + " SELECT * FROM mx", "ev")),
    Query("g36_run_metrics", lambda c: r6(B.run_metrics(c.events)), W("WITH " + _MET.rstrip(", ") + " SELECT repo_id, run_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in _MCOLS) + " FROM met", "evl")),
    Query("g36_baselines", lambda c: r6(B.baselines(B.run_metrics(c.events).withColumn("delegation_latency_p95_ms", F.col("delegation_latency_p95_ms") / 1e6)), 4), W(
        "WITH " + _MET + _UNPIV.replace("delegation_latency_p95_ms AS v", "delegation_latency_p95_ms / 1e6 AS v") + _SPEC + "SELECT repo_id, metric, finding_id, scanner_metric, unit, round(avg(v), 4) AS observed_baseline, round(stddev_pop(v), 4) AS observed_stddev, "
        "round(CASE WHEN any_value(cap) THEN least(avg(v) + 2 * stddev_pop(v), 1) ELSE avg(v) + 2 * stddev_pop(v) END, 4) AS suggested_threshold, CASE WHEN count(*) >= 10 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS sample_size "
        "FROM lg JOIN sp USING (metric) GROUP BY repo_id, metric, finding_id, scanner_metric, unit", "evl")),
    Query("g45_run_metrics_payload", lambda c: r6(B.run_metrics_payload(c.events)), W(
        _PAY, "ev")),
    Query("g44_baselines_uncapped", lambda c: r6(B.baselines(B.run_metrics_payload(c.events), capped=False), 4), W(
        "WITH met AS (" + _PAY + "), " + _UNPIV + _SPEC + "SELECT repo_id, metric, finding_id, scanner_metric, unit, round(avg(v), 4) AS observed_baseline, round(stddev_pop(v), 4) AS observed_stddev, round(avg(v) + 2 * stddev_pop(v), 4) AS suggested_threshold, "
        "CASE WHEN count(v) >= 3 THEN 'medium' ELSE 'low' END AS confidence, count(v) AS sample_size FROM lg JOIN sp USING (metric) WHERE v IS NOT NULL GROUP BY repo_id, metric, finding_id, scanner_metric, unit", "ev")),
    Query("g46_handoffs", lambda c: handoffs(c), W("WITH " + _HO.rstrip(", ") + " SELECT repo_id, run_id, CAST(event_id AS VARCHAR) AS event_id, source, target, content_hash, cd AS has_classification_dependency, validated FROM ho", "evl", "nodes", "edges")),
    Query("g48_blast_radius", lambda c: L.blast_radius(handoffs(c)), W("WITH " + _HREACH + "SELECT repo_id, origin AS node, blast_radius FROM br", "evl", "nodes", "edges", recursive=True)),
    Query("g46_lineage_summary", lambda c: r6(L.lineage_summary(handoffs(c), resolved(c)).drop("semantic_chain_depth")), W(
        "WITH " + _HREACH.rstrip() + ", a AS (SELECT repo_id, count(*) AS t, count(*) FILTER (NOT validated) AS u FROM ho GROUP BY ALL), m AS (SELECT repo_id, max(blast_radius) AS b FROM br GROUP BY ALL), k AS (SELECT repo_id, count(DISTINCT rs) AS n FROM ou WHERE classified IS NOT NULL GROUP BY ALL) "
        "SELECT r.repo_id, coalesce(t, 0) AS total_handoffs, coalesce(u, 0) AS unvalidated_count, coalesce(b, 0) AS max_blast_radius, coalesce(k.n, 0) AS classification_injection_count, round(coalesce(u, 0) / greatest(coalesce(t, 0), 1), 6) AS unvalidated_fraction "
        "FROM (SELECT DISTINCT repo_id FROM ev) r LEFT JOIN a USING (repo_id) LEFT JOIN m USING (repo_id) LEFT JOIN k USING (repo_id)", "evl", "nodes", "edges", recursive=True)),
    Query("g49_chain_depth", lambda c: L.lineage_summary(handoffs(c), resolved(c)).select("repo_id", "semantic_chain_depth"), W(
        "WITH " + _HO + "ha AS MATERIALIZED (SELECT DISTINCT repo_id, source, target FROM ho WHERE source <> '' AND target <> ''), lw AS (SELECT DISTINCT repo_id, source AS node, [source] AS seen FROM ha UNION SELECT w.repo_id, a.target, list_sort(list_append(w.seen, a.target)) FROM lw w JOIN ha a ON a.repo_id = w.repo_id AND a.source = w.node AND NOT list_contains(w.seen, a.target)), "
        "ld AS (SELECT lw.repo_id, max(len(seen) - CASE WHEN EXISTS (SELECT 1 FROM ha a WHERE a.repo_id = lw.repo_id AND a.source = lw.node) THEN 0 ELSE 1 END) AS d FROM lw GROUP BY 1) SELECT repo_id, coalesce(d, 0) AS semantic_chain_depth FROM (SELECT DISTINCT repo_id FROM ev) r LEFT JOIN ld USING (repo_id)", "evl", "nodes", "edges", recursive=True)),
    Query("g50_output_determinism", lambda c: r6(L.output_determinism(resolved(c))), W(
        "WITH " + REFMAP + EVR + "rz AS (SELECT *, coalesce(src, source_id) AS rs FROM evr), gi AS (SELECT run_id, arg_max(input_hash, timestamp_ns) AS ih FROM ev WHERE event_type = 'execution.start' GROUP BY run_id) "
        "SELECT repo_id, rs AS node, ih AS input_hash, count(*) AS same_input_outputs, count(DISTINCT output_hash) AS unique_outputs, count(DISTINCT output_hash) = 1 AS deterministic, round(1 - (count(DISTINCT output_hash) - 1) / (count(*) - 1), 6) AS consistency "
        "FROM rz JOIN gi USING (run_id) WHERE output_hash IS NOT NULL GROUP BY repo_id, rs, ih HAVING count(*) >= 2", "evl", "nodes")),
]
