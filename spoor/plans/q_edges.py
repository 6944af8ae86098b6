"""Registered queries: emergent and dead edges."""

from __future__ import annotations


from spoor.operators import edges as E
from spoor.operators import rollup as R
from spoor.plans.corpus import Query, r6
from spoor.plans.q_overlay import RUNS, _REFS, _refmap, raw_map, s_norm
from spoor.sources.tables import with_ctes as W

RAW = _REFS + _refmap("rawmap", False) + (
    "iv AS (SELECT e.*, coalesce(a.node_id, nullif(source_id, ''), nullif(source_name, '')) AS s, coalesce(b.node_id, nullif(target_id, ''), nullif(target_name, '')) AS tt FROM ev e "
    "LEFT JOIN rawmap a ON e.repo_id = a.repo_id AND e.source_id = a.ref_id AND e.source_name = a.ref_name LEFT JOIN rawmap b ON e.repo_id = b.repo_id AND e.target_id = b.ref_id AND e.target_name = b.ref_name), "
)
_ETYPE = "coalesce(edge_type, CASE WHEN event_type LIKE '%delegat%' THEN 'delegates_to' WHEN event_type LIKE '%tool%' THEN 'calls' WHEN event_type LIKE '%read%' THEN 'reads_from' WHEN event_type LIKE '%write%' THEN 'writes_to' ELSE 'unknown' END)"
_RT = (
    "rt AS (SELECT * FROM (SELECT repo_id, run_id, timestamp_ns, event_id, parent_node AS source, source_id AS target, 'delegates_to' AS edge_type FROM ev WHERE event_type = 'agent.task_start' UNION ALL "
    "SELECT repo_id, run_id, timestamp_ns, event_id, input_source, source_id, 'reads_from' FROM ev WHERE event_type = 'agent.task_start' UNION ALL "
    "SELECT repo_id, run_id, timestamp_ns, event_id, stack_top, source_id, 'calls' FROM ev WHERE event_type = 'llm.call_end' UNION ALL "
    "SELECT repo_id, run_id, timestamp_ns, event_id, source_id, tool_node, 'uses' FROM ev WHERE event_type = 'tool.invoked' UNION ALL "
    "SELECT repo_id, run_id, timestamp_ns, event_id, accessor, state_key, CASE WHEN access_type = 'write' THEN 'writes_to' ELSE 'reads_from' END FROM ev WHERE event_type = 'state.access' UNION ALL "
    "SELECT repo_id, run_id, timestamp_ns, event_id, source_id, target_id, 'delegates_to' FROM ev WHERE event_type = 'delegation.initiated' UNION ALL "
    "SELECT repo_id, run_id, timestamp_ns, event_id, routing_source, routing_target, 'delegates_to' FROM ev WHERE event_type = 'routing.decision') WHERE source <> '' AND target <> ''), "
)
_SEENN = "seenn AS (SELECT DISTINCT repo_id, run_id, node FROM (SELECT repo_id, run_id, source_id AS node FROM ev UNION ALL SELECT repo_id, run_id, target_id FROM ev) WHERE node <> ''), "
_CAT = (
    "CASE WHEN contains(lower(source_name), 'crew') OR event_type = 'execution.start' THEN 'orchestrator' WHEN source_type = 'capability' OR event_type LIKE 'llm.%' THEN 'capability' "
    "WHEN contains(lower(source_name), 'tool') OR event_type LIKE 'tool.%' THEN 'capability' WHEN event_type LIKE 'agent.%' THEN 'agent' WHEN contains(lower(source_name), 'state') OR contains(lower(source_name), 'store') THEN 'data_store' "
    "WHEN contains(lower(source_name), 'guard') OR contains(lower(source_name), 'review') THEN 'guard' ELSE 'agent' END"
)
_IMPL = (
    "acc AS (SELECT repo_id, state_key, src_struct AS node, count(*) FILTER (access_type IN ('write', 'read_write')) AS w, count(*) FILTER (access_type IN ('read', 'read_write')) AS r FROM ev WHERE event_type = 'state.access' GROUP BY ALL), "
    "tot AS (SELECT repo_id, state_key, CAST(least(sum(w), sum(r)) AS BIGINT) AS interaction_count FROM acc GROUP BY ALL), "
    "impl AS (SELECT a.repo_id, a.node AS writer, b.node AS reader, a.state_key, interaction_count FROM acc a JOIN acc b ON a.repo_id = b.repo_id AND a.state_key = b.state_key AND a.node <> b.node AND a.w > 0 AND b.r > 0 JOIN tot ON tot.repo_id = a.repo_id AND tot.state_key = a.state_key "
    "WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = a.repo_id AND e.source = a.node AND e.target = b.node)), "
)
_SHORT = s_norm("replace(replace({0}, 'agent_', ''), 'cap_', '')")
_V2 = _IMPL + RUNS + (
    "dl AS (SELECT *, coalesce(nullif(source_id, ''), nullif(source_name, '')) AS s, coalesce(nullif(target_id, ''), nullif(target_name, '')) AS tt FROM ev WHERE event_type = 'delegation.initiated'), "
    f"en AS MATERIALIZED (SELECT DISTINCT repo_id, source, target, {_SHORT.format('source')} AS sn, {_SHORT.format('target')} AS tn FROM edges), "
    "fd AS (SELECT repo_id, s, tt, arg_min(timestamp_ns, timestamp_ns) AS ts, arg_min(coalesce(delegation_type, ''), timestamp_ns) AS dt FROM dl WHERE s IS NOT NULL AND tt IS NOT NULL GROUP BY ALL), "
    "rd AS (SELECT repo_id, routing_source AS s, routing_target AS tt, arg_min(decision_basis, timestamp_ns) AS basis FROM ev WHERE event_type = 'routing.decision' GROUP BY ALL), "
    f"cand AS (SELECT *, {s_norm('s')} AS a, {s_norm('tt')} AS b FROM (SELECT repo_id, s, tt, ts, dt, NULL AS basis FROM fd UNION ALL SELECT repo_id, s, tt, NULL, NULL, basis FROM rd)), "
    "ok AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM en WHERE en.repo_id = c.repo_id AND ((en.source = s AND en.target = tt) OR ((contains(a, sn) OR contains(sn, a)) AND (contains(b, tn) OR contains(tn, b)))))), "
    "fin AS (SELECT repo_id, s, tt, 'delegates_to' AS edge_type, (SELECT count(*) FROM dl WHERE dl.repo_id = ok.repo_id AND dl.source_name = ok.s AND dl.target_name = ok.tt) AS n, "
    "CASE WHEN EXISTS (SELECT 1 FROM ev WHERE ev.repo_id = ok.repo_id AND ev.event_type LIKE 'error.%' AND abs(ev.timestamp_ns - ok.ts) < 5000000000) THEN 'error_triggered_fallback' WHEN dt = 'framework_internal' THEN 'framework_internal_routing' ELSE 'dynamic_delegation' END AS discovery_type, CAST(NULL AS VARCHAR) AS k FROM ok WHERE basis IS NULL "
    "UNION ALL SELECT repo_id, s, tt, 'delegates_to', 1, CASE WHEN basis = 'llm_output' THEN 'dynamic_delegation' ELSE 'framework_internal_routing' END, NULL FROM ok WHERE basis IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ok o WHERE o.basis IS NULL AND o.repo_id = ok.repo_id AND o.s = ok.s AND o.tt = ok.tt) "
    "UNION ALL SELECT repo_id, writer, reader, 'shares_with', interaction_count, 'implicit_data_sharing', state_key FROM impl) "
)

QUERIES = [
    Query("f1_emergent_edges", lambda c: r6(E.emergent_edges(c.events, raw_map(c), c.nodes, c.edges)), W(
        "WITH " + RAW + RUNS + f"ty AS (SELECT repo_id, s, tt, {_ETYPE} AS ty, count(*) AS n, min(timestamp_ns) AS f FROM iv WHERE s IS NOT NULL AND tt IS NOT NULL GROUP BY ALL), "
        "p AS (SELECT repo_id, s, tt, sum(n) AS n, arg_max(ty, n * 1e19 - f) AS ty FROM ty GROUP BY ALL), tr AS (SELECT repo_id, s, tt, string_agg(DISTINCT trigger, '; ' ORDER BY trigger) AS tr FROM iv WHERE trigger IS NOT NULL GROUP BY ALL) "
        "SELECT p.repo_id, p.s AS source, p.tt AS target, ty AS edge_type, CAST(n AS BIGINT) AS traversal_count, round(n / total_runs, 6) AS activation_rate, tr AS trigger_condition, "
        "CASE WHEN p.s NOT IN (SELECT node_id FROM tmpl) OR p.tt NOT IN (SELECT node_id FROM tmpl) THEN 'high' WHEN n <= 2 THEN 'low' ELSE 'medium' END AS significance FROM p JOIN runs USING (repo_id) LEFT JOIN tr ON tr.repo_id = p.repo_id AND tr.s = p.s AND tr.tt = p.tt "
        "WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = p.repo_id AND e.source = p.s AND e.target = p.tt)", "ev", "nodes", "edges")),
    Query("f2_emergent_by_discovery", lambda c: r6(E.emergent_by_discovery(c.events, c.edges).drop("trigger_condition", "detection_heuristic")), W(
        "WITH " + _V2 + "SELECT repo_id, s AS source, tt AS target, edge_type, CAST(n AS BIGINT) AS activation_count, round(n / total_runs, 6) AS activation_rate, discovery_type, k AS shared_state_key FROM fin JOIN runs USING (repo_id)", "ev", "edges")),
    Query("f5_heuristic_texts", lambda c: E.emergent_by_discovery(c.events, c.edges).select("repo_id", "source", "target", "trigger_condition", "detection_heuristic"), W(
        "WITH " + _V2 + ", bs AS (SELECT fin.*, (SELECT any_value(coalesce(basis, 'unknown')) FROM ok WHERE fin.k IS NULL AND ok.basis IS NOT NULL AND ok.repo_id = fin.repo_id AND ok.s = fin.s AND ok.tt = fin.tt AND NOT EXISTS (SELECT 1 FROM ok o WHERE o.basis IS NULL AND o.repo_id = fin.repo_id AND o.s = fin.s AND o.tt = fin.tt)) AS basis FROM fin) "
        "SELECT repo_id, s AS source, tt AS target, CASE WHEN basis IS NOT NULL THEN 'routing decision (unknown) based on ' || basis WHEN k IS NOT NULL THEN concat('both agents access state key ''', k, '''') WHEN discovery_type = 'error_triggered_fallback' THEN 'error in upstream node triggered fallback delegation' "
        "WHEN discovery_type = 'framework_internal_routing' THEN 'framework orchestrator created routing path' ELSE 'LLM-chosen or dynamic routing decision' END AS trigger_condition, "
        "CASE WHEN basis IS NOT NULL THEN concat('The router (unknown, by ', basis, ') sends ''', s, ''' to ''', tt, '''; no structural edge says so.') WHEN k IS NOT NULL THEN concat('State key ''', k, ''' joins ', s, ' and ', tt, '; a shares_with edge would show it.') "
        "WHEN discovery_type = 'error_triggered_fallback' THEN concat('Watch for ''', tt, ''' taking over when ''', s, ''' fails; add a conditional delegates_to edge for errors.') WHEN discovery_type = 'dynamic_delegation' THEN concat('Watch what the model routes from ''', s, ''' to ''', tt, '''; add a dynamic delegates_to edge.') "
        "ELSE concat('The framework itself routes ''', s, ''' to ''', tt, '''; user code does not name this path.') END AS detection_heuristic FROM bs", "ev", "edges")),
    Query("f3_delegations_near_errors", lambda c: E.near_errors(c.events.filter("event_type = 'delegation.initiated'").select("repo_id", "event_id", "timestamp_ns"), c.events, 3_600_000_000_000), W(
        "SELECT repo_id, CAST(event_id AS VARCHAR) AS event_id, timestamp_ns FROM ev d WHERE event_type = 'delegation.initiated' AND EXISTS (SELECT 1 FROM ev e WHERE e.repo_id = d.repo_id AND e.event_type LIKE 'error.%' AND abs(e.timestamp_ns - d.timestamp_ns) < 3600000000000)", "ev")),
    Query("f7_implicit_sharing", lambda c: E.implicit_sharing(c.events, c.edges), W("WITH " + _IMPL.rstrip(", ") + " SELECT * FROM impl", "ev", "edges")),
    Query("f8_dead_edges", lambda c: E.dead_edges(c.events, raw_map(c), c.edges), W(
        "WITH " + RAW + RUNS + "sg AS (SELECT DISTINCT repo_id, s FROM iv WHERE target_id IS NULL) SELECT e.repo_id, e.edge_id, e.source, e.target, e.edge_type, total_runs AS runs_observed, "
        "CASE WHEN condition IS NULL AND edge_type <> 'filtered_by' AND total_runs >= 5 THEN 'dead_code,input_dependent' ELSE concat_ws(',', CASE WHEN condition IS NOT NULL THEN 'conditional_never_true' END, CASE WHEN edge_type = 'filtered_by' THEN 'conditional_never_true' END, CASE WHEN total_runs < 5 THEN 'input_dependent' END) END AS possible_reasons "
        "FROM edges e JOIN runs USING (repo_id) WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.repo_id = e.repo_id AND iv.s = e.source AND iv.tt = e.target) "
        "AND NOT (edge_type IN ('guarded_by', 'filtered_by') AND EXISTS (SELECT 1 FROM sg WHERE sg.repo_id = e.repo_id AND sg.s IN (e.source, e.target)))", "ev", "nodes", "edges")),
    Query("f13_inferred_nodes", lambda c: E.inferred_graph(c.events)[0].drop("name"), W(
        f"WITH one AS (SELECT * FROM ev WHERE (repo_id, run_id) IN (SELECT (repo_id, min(run_id)) FROM ev GROUP BY repo_id)) SELECT repo_id, source_id AS node_id, arg_min({_CAT}, timestamp_ns) AS node_type FROM one WHERE source_id <> '' GROUP BY ALL", "ev")),
    Query("f13_inferred_edges", lambda c: E.inferred_graph(c.events)[1].drop("edge_id"), W(
        "WITH " + _RT.rstrip(", ") + " SELECT DISTINCT repo_id, source, target, edge_type FROM rt WHERE (repo_id, run_id) IN (SELECT (repo_id, min(run_id)) FROM ev GROUP BY repo_id)", "ev")),
    Query("f15_runtime_edges", lambda c: E.runtime_edges(c.events).drop("timestamp_ns"), W("WITH " + _RT.rstrip(", ") + " SELECT repo_id, run_id, CAST(event_id AS VARCHAR) AS event_id, source, target, edge_type FROM rt", "ev")),
    Query("f16_run_edge_validation", lambda c: r6(E.run_edge_validation(c.edges, c.events)), W(
        "WITH " + _RT + _SEENN + RUNS + "z AS (SELECT e.repo_id, e.edge_id, e.source, e.target, e.edge_type, total_runs, count(DISTINCT rt.run_id) AS n, EXISTS (SELECT 1 FROM seenn WHERE seenn.repo_id = e.repo_id AND node = e.source) AS ss, EXISTS (SELECT 1 FROM seenn WHERE seenn.repo_id = e.repo_id AND node = e.target) AS ts "
        "FROM edges e JOIN runs USING (repo_id) LEFT JOIN rt ON rt.repo_id = e.repo_id AND rt.source = e.source AND rt.target = e.target AND rt.edge_type = e.edge_type GROUP BY ALL) "
        "SELECT repo_id, edge_id, source, target, edge_type, n AS traversal_count, round(n / total_runs, 6) AS activation_rate, CASE WHEN n = 0 THEN concat_ws(',', CASE WHEN NOT ss THEN 'source_node_never_activated:' || source END, CASE WHEN NOT ts THEN 'target_node_never_activated:' || target END, "
        "CASE WHEN ss AND ts THEN 'nodes_active_but_edge_never_traversed' END) END AS possible_reasons FROM z", "ev", "edges")),
    Query("f19_run_emergent_edges", lambda c: r6(E.run_emergent_edges(c.edges, c.events)), W(
        "WITH " + _RT + RUNS.rstrip(", ") + " SELECT repo_id, source, target, edge_type, count(DISTINCT run_id) AS observed_in_runs, round(count(DISTINCT run_id) / any_value(total_runs), 6) AS observation_rate, CASE WHEN count(DISTINCT run_id) = any_value(total_runs) THEN 'consistent' ELSE 'intermittent' END AS classification "
        "FROM rt JOIN runs USING (repo_id) WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = rt.repo_id AND e.source = rt.source AND e.target = rt.target) GROUP BY repo_id, source, target, edge_type", "ev", "edges")),
    Query("f20_run_node_activation", lambda c: E.run_node_activation(R.nodes_seen(c.events).unionByName(c.nodes.select("repo_id", "node_id")), c.events), W(
        "WITH " + _SEENN + RUNS + "ids AS (SELECT DISTINCT repo_id, node FROM seenn UNION SELECT repo_id, node_id FROM nodes), n AS (SELECT repo_id, node, count(*) AS k FROM seenn GROUP BY ALL) "
        "SELECT repo_id, node AS node_id, coalesce(k, 0) AS runs_active, CASE WHEN coalesce(k, 0) = total_runs THEN 'always_active' WHEN k > 0 THEN 'conditional' ELSE 'never_active' END AS category FROM ids JOIN runs USING (repo_id) LEFT JOIN n USING (repo_id, node)", "ev", "nodes")),
]
