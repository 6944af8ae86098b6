"""Registered queries: reference resolution, graph overlay, emergent and dead edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.constants import ACTIVATION_END, ACTIVATION_START, EVENT_EDGES, EVENT_ROLES, LATENCY_END, LATENCY_START, NODE_ACTIVITY, SOURCE_RAN, TARGET_RAN
from spoor.operators import graph as G
from spoor.operators import overlay as O
from spoor.operators import resolve as D
from spoor.plans.corpus import Corpus, Query, r6
from spoor.sources.tables import with_ctes as W


def s_in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def s_norm(x: str) -> str:
    camel = f"regexp_replace(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z\\d])([A-Z])', '\\1_\\2', 'g')"
    return f"trim(regexp_replace(translate(lower({camel}), ' -', '__'), '_+', '_', 'g'), '_')"


def s_strip(x: str) -> str:
    for p in ("agent_", "cap_", "ds_", "ext_", "guard_"):
        x = f"replace({x}, '{p}', '')"
    return x


S_ERR = "event_type IN ('error.occurred', 'error.propagated', 'error.cascade', 'tool.call_failure')"
_REFS = (
    "refs AS (SELECT *, " + s_norm("ref_name") + " AS nname, CASE WHEN len(string_split(ref_id, ':')) >= 4 THEN " + s_norm("string_split(ref_id, ':')[2]")
    + " END AS ncls FROM (SELECT repo_id, source_id AS ref_id, source_name AS ref_name FROM ev UNION SELECT repo_id, target_id, target_name FROM ev WHERE target_id IS NOT NULL "
    "UNION SELECT repo_id, '', agent_ref FROM ev WHERE agent_ref IS NOT NULL)), "
)


def _refmap(name: str, types: bool) -> str:
    extra = (
        f"WHEN nname <> '' AND ({s_norm('name')} = nname OR {s_norm('class_name')} = nname) THEN 11 "
        "WHEN ref_name <> '' AND node_id = 'ds_' || translate(replace(replace(lower(ref_name), '(', ''), ')', ''), ' ', '_') THEN 12 "
        "WHEN ref_name <> '' AND node_id = 'ext_' || translate(replace(replace(lower(ref_name), '(', ''), ')', ''), ' ', '_') THEN 13 "
    ) if types else ""
    return (
        f"{name} AS (SELECT repo_id, ref_id, ref_name, arg_min(node_id, pr * 100 + node_ord) AS node_id FROM ("
        "SELECT r.*, n.node_id, n.node_ord, CASE WHEN ref_id <> '' AND ref_id = node_id THEN 1 "
        "WHEN ncls IS NOT NULL AND node_id = 'agent_' || ncls THEN 2 "
        "WHEN ncls IS NOT NULL AND NOT ends_with(ncls, '_agent') AND node_id = 'agent_' || ncls || '_agent' THEN 3 "
        "WHEN ncls IS NOT NULL AND NOT ends_with(ncls, '_crew') AND node_id = 'agent_' || ncls || '_crew' THEN 4 "
        "WHEN ncls IS NOT NULL AND NOT ends_with(ncls, '_graph') AND node_id = 'agent_' || ncls || '_graph' THEN 5 "
        "WHEN ncls IS NOT NULL AND ends_with(string_split(ref_id, ':')[3], source_file) AND string_split(ref_id, ':')[4] = CAST(line_number AS VARCHAR) THEN 6 "
        "WHEN ncls IS NOT NULL AND contains(node_id, ncls) THEN 7 "
        f"WHEN nname <> '' AND node_id = 'agent_' || nname THEN 10 {extra}"
        "WHEN nname <> '' AND contains(node_id, nname) THEN 14 END AS pr FROM refs r JOIN nodes n ON r.repo_id = n.repo_id) WHERE pr IS NOT NULL GROUP BY ALL), "
    )


REFMAP = _REFS + _refmap("refmap", True)
_ROLE_T, _ROLE_A = (s_in([t for t, r in EVENT_ROLES.items() if role in r]) for role in ("target", "agent"))
EVR = (
    "evr AS (SELECT e.*, a.node_id AS src, b.node_id AS tgt, g.node_id AS agent FROM evl e "
    "LEFT JOIN refmap a ON e.repo_id = a.repo_id AND e.source_id = a.ref_id AND e.source_name = a.ref_name "
    "LEFT JOIN refmap b ON e.repo_id = b.repo_id AND e.target_id = b.ref_id AND e.target_name = b.ref_name "
    "LEFT JOIN refmap g ON e.repo_id = g.repo_id AND g.ref_id = '' AND e.agent_ref = g.ref_name), "
)
NE = (
    f"ne AS (SELECT DISTINCT * FROM (SELECT evr.*, src AS node_id FROM evr UNION ALL SELECT evr.*, tgt FROM evr WHERE event_type IN {_ROLE_T} "
    f"UNION ALL SELECT evr.*, agent FROM evr WHERE event_type IN {_ROLE_A}) WHERE node_id IS NOT NULL), "
)
RUNS = "runs AS (SELECT repo_id, count(DISTINCT run_id) AS total_runs FROM ev GROUP BY 1), "
_BAD_END = f"(event_type IN {s_in(ACTIVATION_END)} AND status IN ('error', 'failure', 'crash'))"
NB = REFMAP + EVR + NE + RUNS
_N = f"FILTER (event_type IN {s_in(ACTIVATION_START)})"

# edges traversed by an event, by the rules of each type
def _edge_rules() -> str:
    parts = []
    for et, rules in EVENT_EDGES.items():
        for a, b, types in rules:
            has = {"source": "true", "target": "(target_id IS NOT NULL)", "agent": "(agent_ref IS NOT NULL OR source_type = 'agent')"}
            rid = {"source": "src", "target": "tgt", "agent": "(CASE WHEN agent_ref IS NOT NULL THEN agent ELSE src END)"}
            t = s_in(types)
            parts.append(
                f"(event_type = '{et}' AND (({has[a]} AND {has[b]} AND ((source = {rid[a]} AND target = {rid[b]}) OR (source = {rid[b]} AND target = {rid[a]} AND g.edge_type IN {t}))) "
                f"OR ({has[a]} AND NOT {has[b]} AND {rid[a]} IN (source, target) AND g.edge_type IN {t}) OR ({has[b]} AND NOT {has[a]} AND {rid[b]} IN (source, target) AND g.edge_type IN {t})))"
            )
    parts.append(f"(event_type NOT IN {s_in(list(EVENT_EDGES))} AND target_id IS NOT NULL AND source = src AND target = tgt)")
    return " OR ".join(parts)


EE = f"ee AS (SELECT e.*, g.edge_id, g.edge_ord FROM evr e JOIN edges g ON e.repo_id = g.repo_id AND ({_edge_rules()})), "
_PATH = "[src_struct, tgt_struct, CASE ((t + 2) % 9) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(
    ["agent_planner", "agent_research_lead", "agent_writer_crew", "agent_reviewer", "agent_intake_router", "cap_SearchTool_tool", "ds_vector_store", "ext_web_api", "guard_input_12"])) + " END]"
SYN = (
    "syn AS (SELECT h.repo_id, h.run_id, e.edge_id, h.error_type, h.impact FROM ("
    f"SELECT repo_id, run_id, coalesce(error_type, 'unknown_error') AS error_type, downstream_impact AS impact, unnest([{{'a': pp[1], 'b': pp[2]}}, {{'a': pp[2], 'b': pp[3]}}]) AS hop "
    f"FROM (SELECT *, {_PATH} AS pp FROM ev WHERE event_type = 'error.propagated') "
    "UNION ALL SELECT repo_id, run_id, coalesce(error_type, 'cascade'), true, {'a': origin_node, 'b': terminal_node} FROM ev WHERE event_type = 'error.cascade') h "
    "JOIN edges e ON e.repo_id = h.repo_id AND e.source = h.hop.a AND e.target = h.hop.b), "
)
_IDN = "coalesce(nullif({0}_id, ''), nullif({0}_name, ''))"
PAIRS = (
    "pairs AS (SELECT repo_id, s, t, count(*) AS n FROM (SELECT repo_id, "
    f"CASE WHEN event_type = 'routing.decision' THEN routing_source ELSE {_IDN.format('source')} END AS s, CASE WHEN event_type = 'routing.decision' THEN routing_target ELSE {_IDN.format('target')} END AS t "
    "FROM ev WHERE event_type IN ('delegation.initiated', 'routing.decision', 'tool.invoked', 'data.read', 'data.write', 'external.call', 'message.received')) "
    "WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY ALL), "
)


_RAWS = "SELECT DISTINCT repo_id, raw, " + s_norm("raw") + " AS rn FROM (SELECT repo_id, s AS raw FROM pairs UNION SELECT repo_id, t FROM pairs)"
_ENDS = "SELECT DISTINCT repo_id, node, " + s_norm(s_strip("node")) + " AS nn FROM (SELECT repo_id, source AS node FROM edges UNION SELECT repo_id, target FROM edges)"
FZ = (
    f"raws AS MATERIALIZED ({_RAWS}), ends AS MATERIALIZED ({_ENDS}), "
    "fz AS MATERIALIZED (SELECT raws.repo_id, raw, node FROM raws JOIN ends ON raws.repo_id = ends.repo_id AND (raw = node OR contains(rn, nn) OR contains(nn, rn))), "
)
ACT = PAIRS + FZ + (
    "exact AS (SELECT e.*, p.n FROM edges e LEFT JOIN pairs p ON e.repo_id = p.repo_id AND e.source = p.s AND e.target = p.t), "
    "fuzzy AS (SELECT x.repo_id, x.edge_id, sum(p.n) AS fn FROM exact x JOIN fz a ON a.repo_id = x.repo_id AND a.node = x.source JOIN fz b ON b.repo_id = x.repo_id AND b.node = x.target "
    "JOIN pairs p ON x.repo_id = p.repo_id AND p.s = a.raw AND p.t = b.raw WHERE x.n IS NULL GROUP BY ALL), "
    "act AS MATERIALIZED (SELECT x.*, CAST(coalesce(x.n, f.fn, 0) AS BIGINT) AS activation_count FROM exact x LEFT JOIN fuzzy f USING (repo_id, edge_id)), "
)


def _ran(name: str, types: list[str]) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT DISTINCT repo_id, raw, {s_norm('raw')} AS rn FROM (SELECT repo_id, {_IDN.format('source')} AS raw FROM ev WHERE event_type IN {s_in(types)} "
        f"UNION ALL SELECT repo_id, {_IDN.format('target')} FROM ev WHERE event_type IN {s_in(types)}) WHERE raw IS NOT NULL), "
    )


def _mentioned(cte: str, node: str) -> str:
    return f"EXISTS (SELECT 1 FROM {cte} m WHERE m.repo_id = act.repo_id AND (m.raw = {node} OR m.rn = {s_norm(s_strip(node))}))"


VAL = RUNS + ACT + _ran("sran", SOURCE_RAN) + _ran("tran", TARGET_RAN) + (
    "rout AS (SELECT DISTINCT repo_id, routing_source, routing_target FROM ev WHERE event_type = 'routing.decision'), "
    "val AS (SELECT act.*, activation_count / total_runs AS activation_rate, CASE WHEN activation_count = 0 THEN CASE "
    f"WHEN NOT {_mentioned('sran', 'act.source')} THEN 'source_never_activated' WHEN NOT {_mentioned('tran', 'act.target')} THEN 'target_never_activated' "
    "WHEN edge_type = 'shares_with' THEN 'shared_state_not_used' WHEN edge_type IN ('gated_by', 'filtered_by') THEN 'guardrail_never_reached' "
    "WHEN EXISTS (SELECT 1 FROM rout r WHERE r.repo_id = act.repo_id AND r.routing_source = act.source) AND NOT EXISTS (SELECT 1 FROM rout r WHERE r.repo_id = act.repo_id AND r.routing_source = act.source AND r.routing_target = act.target) "
    "THEN 'conditional_branch_not_taken' ELSE 'path_not_chosen' END END AS dead_reason FROM act JOIN runs USING (repo_id)) "
)


# ---- shared Spark tables
def ref_map(c: Corpus):
    return c.keep("ref_map", lambda: D.node_ref_map(c.events, c.nodes))


def raw_map(c: Corpus):
    return c.keep("raw_map", lambda: D.node_ref_map(c.events, c.nodes, names_and_types=False))


def behavior(c: Corpus):
    return c.keep("node_behavior", lambda: O.node_behavior(c.nodes, c.events, ref_map(c)))


def closure(c: Corpus):
    return c.keep("closure", lambda: G.reach(c.edges))


REACH = (
    "walk AS (SELECT repo_id, source AS origin, target AS node, 1 AS depth FROM edges WHERE source <> target UNION "
    "SELECT w.repo_id, w.origin, e.target, w.depth + 1 FROM walk w JOIN edges e ON e.repo_id = w.repo_id AND e.source = w.node WHERE w.depth < 8 AND e.target <> w.origin), "
    "far AS (SELECT repo_id, origin, node, min(depth) AS depth FROM walk GROUP BY ALL), "
)
_NODE_COLS = ["repo_id", "node_id"]


def _names(c: Corpus):
    n = c.nodes
    from spoor.functions import text as T

    return n.select("repo_id", "node_id", T.normalize_name(F.col("name")).alias("norm_name"), T.agent_id(F.col("name")).alias("agent_key"),
                    T.capability_id(F.col("class_name"), F.lit("tool")).alias("cap_key"), T.data_store_id(F.col("name")).alias("ds_key"),
                    T.external_id(F.col("name")).alias("ext_key"), T.runtime_id(F.lit("crewai"), F.col("class_name"), F.col("source_file"), F.col("line_number")).alias("run_key"))


_FR = (
    "friendly AS (SELECT repo_id, node_id, name, class_name, source_file, line_number, " + s_norm("name") + " AS nn, replace(replace(replace(lower(name), '(', ''), ')', ''), ' ', '_') AS fr FROM nodes) "
)
_FAIL_SQL = (
    "base AS (SELECT *, " + s_norm("source_name") + " AS who_name, " + s_norm("coalesce(nullif(source_name, ''), source_id)") + " AS who, coalesce(" + s_norm("tool_name") + ", '') AS tool, coalesce(" + s_norm("agent_ref") + ", '') AS inv, "
    "event_type IN ('error.occurred', 'error.propagated', 'error.cascade') AS e3, event_type IN ('error.occurred', 'error.propagated') AS e2, event_type IN ('agent.task_start', 'agent.task_end') AS tk, "
    "(is_retry OR (event_type = 'tool.completed' AND status = 'success')) AS rec, CAST(event_id AS VARCHAR) AS eid FROM ev), "
    "caps AS (SELECT repo_id, node_id, " + s_norm("name") + " AS cap FROM nodes WHERE node_type = 'capability'), "
    "fl AS (SELECT b.*, c.node_id, c.cap FROM base b JOIN caps c ON b.repo_id = c.repo_id AND (b.source_id = c.node_id OR b.who = c.cap OR b.tool = c.cap) "
    "WHERE event_type = 'tool.call_failure' OR (event_type = 'tool.completed' AND status IN ('error', 'failure'))), "
    "j AS (SELECT fl.repo_id, fl.node_id, fl.run_id, fl.eid, any_value(fl.timestamp_ns) AS ts, count(*) FILTER (b.e3) AS d3, count(*) FILTER (b.e3 AND fl.inv <> '' AND b.who <> '' AND b.who <> fl.inv) AS oth, "
    "min(b.timestamp_ns) FILTER (b.rec AND b.tool = fl.cap) AS rts, count(*) FILTER (b.tk AND b.who_name <> fl.inv) AS otk, count(*) FILTER (b.e2 AND b.who_name <> fl.inv) AS oe2 "
    "FROM fl LEFT JOIN base b ON b.run_id = fl.run_id AND (b.timestamp_ns > fl.timestamp_ns OR (b.timestamp_ns = fl.timestamp_ns AND b.eid > fl.eid)) GROUP BY fl.repo_id, fl.node_id, fl.run_id, fl.eid) "
)

QUERIES = [
    Query("d1_names_and_ids", _names, W(
        "WITH " + _FR + "SELECT repo_id, node_id, nn AS norm_name, 'agent_' || nn AS agent_key, 'cap_' || class_name || '_tool' AS cap_key, 'ds_' || fr AS ds_key, 'ext_' || fr AS ext_key, "
        "'crewai:' || class_name || ':' || source_file || ':' || CAST(line_number AS VARCHAR) AS run_key FROM friendly", "nodes")),
    Query("d8_ref_map_ids_and_names", lambda c: D.node_ref_map(c.events, c.nodes, names_and_types=False), W("WITH " + _REFS + _refmap("m", False).rstrip(", ") + " SELECT * FROM m", "ev", "nodes")),
    Query("d9_ref_map", lambda c: D.node_ref_map(c.events, c.nodes), W("WITH " + REFMAP.rstrip(", ") + " SELECT * FROM refmap", "ev", "nodes")),
    Query("d11_resolved_events", lambda c: D.resolved_ids(c.events, ref_map(c)).select("event_id", F.col("source_node.node_id").alias("source_id"), F.col("target_node.node_id").alias("target_id")), W(
        "WITH " + REFMAP + EVR.rstrip(", ") + " SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(src, source_id) AS source_id, coalesce(tgt, target_id) AS target_id FROM evr", "evl", "nodes")),
    Query("d13_name_lookup", lambda c: D.name_to_id(c.nodes), W(
        "SELECT repo_id, ref, arg_max(node_id, node_ord) AS node_id FROM (SELECT repo_id, node_ord, node_id, node_id AS ref FROM nodes UNION ALL SELECT repo_id, node_ord, node_id, name FROM nodes) GROUP BY ALL", "nodes")),
    Query("d14_events_on_nodes", lambda c: O.node_events(c.events, ref_map(c)).select("event_id", "repo_id", "node_id"), W("WITH " + REFMAP + EVR + NE.rstrip(", ") + " SELECT CAST(event_id AS VARCHAR) AS event_id, repo_id, node_id FROM ne", "evl", "nodes")),
    Query("d15_events_on_edges", lambda c: O.edge_events(c.events, ref_map(c), c.edges).select("event_id", "repo_id", "edge_id"), W("WITH " + REFMAP + EVR + EE.rstrip(", ") + " SELECT CAST(event_id AS VARCHAR) AS event_id, repo_id, edge_id FROM ee", "evl", "nodes", "edges")),
    Query("d20_fuzzy_ends", lambda c: O.fuzzy_ends(O.activation_pairs(c.events), c.edges), W("WITH " + PAIRS + FZ.rstrip(", ") + " SELECT * FROM fz", "ev", "edges")),
    Query("e3_node_activity", lambda c: r6(behavior(c).select(*_NODE_COLS, "activation_count", "activation_rate", "completed", "failed", "failure_rate")), W(
        "WITH " + NB + f"m AS (SELECT repo_id, node_id, count(*) {_N} AS activation_count, count(DISTINCT run_id) {_N} AS ar, count(*) FILTER (event_type IN {s_in(ACTIVATION_END)}) AS completed, count(*) FILTER ({S_ERR}) AS failed FROM ne GROUP BY ALL) "
        "SELECT n.repo_id, n.node_id, coalesce(activation_count, 0) AS activation_count, round(coalesce(ar, 0) / total_runs, 6) AS activation_rate, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, "
        "round(coalesce(failed, 0) / greatest(coalesce(activation_count, 0), 1), 6) AS failure_rate FROM nodes n JOIN runs USING (repo_id) LEFT JOIN m USING (repo_id, node_id)", "evl", "nodes")),
    Query("e5_node_latency", lambda c: r6(O.latency_profile(O.node_latencies(O.node_events(c.events, ref_map(c)))).withColumn("variance", F.col("variance") / 1e12), 5), W(
        "WITH " + NB + f"lat AS (SELECT e.repo_id, e.node_id, coalesce((e.timestamp_ns - s.timestamp_ns) / 1e6, CASE WHEN e.latency_ms > 0 THEN floor(e.latency_ms * 1e6) / 1e6 END) AS ms FROM ne e "
        f"LEFT JOIN ne s ON e.repo_id = s.repo_id AND e.node_id = s.node_id AND e.parent_id = s.event_id AND s.event_type IN {s_in(LATENCY_START)} AND s.timestamp_ns <= e.timestamp_ns WHERE e.event_type IN {s_in(LATENCY_END)}) "
        "SELECT repo_id, node_id, round(quantile_cont(ms, 0.5), 5) AS p50, round(quantile_cont(ms, 0.95), 5) AS p95, round(quantile_cont(ms, 0.99), 5) AS p99, round(var_pop(ms) / 1e12, 5) AS variance, count(*) AS sample_count FROM lat WHERE ms IS NOT NULL GROUP BY ALL", "evl", "nodes")),
    Query("e6_node_errors", lambda c: r6(behavior(c).select(*_NODE_COLS, "errors_occurred", "propagated_downstream", "swallowed", "propagation_rate", "default_values_used", F.array_join("observed_error_handling", ",").alias("handling"), "structural_prediction_match")), W(
        "WITH " + NB + f"m AS (SELECT repo_id, node_id, count(*) AS n, count(*) FILTER (event_type = 'error.propagated') AS pr, count(*) FILTER (default_value_used) AS dv, string_agg(DISTINCT error_handling, ',' ORDER BY error_handling) AS h "
        f"FROM ne WHERE {S_ERR} OR {_BAD_END} GROUP BY ALL) SELECT n.repo_id, n.node_id, coalesce(m.n, 0) AS errors_occurred, coalesce(pr, 0) AS propagated_downstream, coalesce(m.n, 0) - coalesce(pr, 0) AS swallowed, "
        "round(coalesce(pr, 0) / greatest(coalesce(m.n, 0), 1), 6) AS propagation_rate, coalesce(dv, 0) AS default_values_used, coalesce(h, '') AS handling, "
        "CASE WHEN strategy IS NOT NULL AND h IS NOT NULL THEN list_contains(string_split(h, ','), strategy) END AS structural_prediction_match FROM nodes n LEFT JOIN m USING (repo_id, node_id)", "evl", "nodes")),
    Query("e7_node_decisions", lambda c: r6(O.decision_behavior(O.node_events(c.events, ref_map(c)))), W(
        "WITH " + NB + "d AS (SELECT * FROM ne WHERE event_type = 'decision.made'), oc AS (SELECT repo_id, node_id, option_hash, count(*) AS n FROM d GROUP BY ALL), tot AS (SELECT repo_id, node_id, sum(n) AS t FROM oc GROUP BY ALL), "
        "ent AS (SELECT repo_id, node_id, -sum(n / t * log2(n / t)) AS h FROM oc JOIN tot USING (repo_id, node_id) GROUP BY ALL), "
        "inp AS (SELECT repo_id, node_id, input_hash, count(DISTINCT option_hash) AS k FROM d GROUP BY ALL HAVING count(*) >= 2), sm AS (SELECT repo_id, node_id, avg(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS s FROM inp GROUP BY ALL), "
        "b AS (SELECT repo_id, node_id, count(*) AS decisions_made, round(count(DISTINCT option_hash) / count(*), 6) AS consistency_diff_input, round(avg(confidence), 6) AS confidence_mean, round(var_pop(confidence), 6) AS confidence_variance FROM d GROUP BY ALL) "
        "SELECT b.*, round(h, 6) AS decision_entropy, round(s, 6) AS consistency_same_input FROM b JOIN ent USING (repo_id, node_id) LEFT JOIN sm USING (repo_id, node_id)", "evl", "nodes")),
    Query("e8_e9_e10_node_resources", lambda c: r6(behavior(c).select(*_NODE_COLS, "tool_call_failures", "tool_call_failure_rate", "retry_activations", "quality_dependent", "avg_tokens", "avg_tool_calls", "avg_llm_calls", "avg_iterations", "trigger_count", "prevented", "bypassed", "guard_retries", "false_positives", "avg_guard_latency_ms")), W(
        "WITH " + NB + "m AS (SELECT repo_id, node_id, count(*) FILTER (event_type = 'tool.call_failure' OR (event_type = 'tool.completed' AND status IN ('error', 'failure'))) AS tf, count(*) FILTER (event_type = 'tool.invoked') AS ti, count(*) FILTER (is_retry) AS rt, "
        "sum(input_tokens + output_tokens) AS tok, count(*) FILTER (event_type = 'llm.call_end') AS le, count(*) FILTER (event_type = 'llm.call_start') AS ls, count(*) FILTER (event_type = 'agent.task_start') AS it, "
        "count(*) FILTER (event_type = 'guardrail.triggered') AS tr, count(*) FILTER (prevented) AS pv, count(*) FILTER (bypassed) AS bp, count(*) FILTER (retry_triggered) AS gr, count(*) FILTER (false_positive) AS fp, avg(latency_ms) FILTER (event_type = 'guardrail.triggered') AS gl FROM ne GROUP BY ALL) "
        "SELECT n.repo_id, n.node_id, coalesce(tf, 0) AS tool_call_failures, round(coalesce(tf, 0) / greatest(coalesce(ti, 0), 1), 6) AS tool_call_failure_rate, coalesce(rt, 0) AS retry_activations, "
        "(coalesce(tf, 0) / greatest(coalesce(ti, 0), 1) > 0.1 OR coalesce(rt, 0) > 0) AS quality_dependent, round(coalesce(tok, 0) / greatest(coalesce(le, 0), 1), 6) AS avg_tokens, round(coalesce(ti, 0) / total_runs, 6) AS avg_tool_calls, "
        "round(coalesce(ls, 0) / total_runs, 6) AS avg_llm_calls, round(coalesce(it, 0) / total_runs, 6) AS avg_iterations, coalesce(tr, 0) AS trigger_count, coalesce(pv, 0) AS prevented, coalesce(bp, 0) AS bypassed, coalesce(gr, 0) AS guard_retries, "
        "coalesce(fp, 0) AS false_positives, round(coalesce(gl, 0), 6) AS avg_guard_latency_ms FROM nodes n JOIN runs USING (repo_id) LEFT JOIN m USING (repo_id, node_id)", "evl", "nodes")),
    Query("e13_e14_edge_behavior", lambda c: r6(O.edge_behavior(c.edges, c.nodes, c.events, ref_map(c)).drop("edge_ord")), W(
        "WITH " + REFMAP + EVR + EE + SYN + RUNS + "x AS (SELECT repo_id, run_id, edge_id, error_type IS NOT NULL OR event_type IN ('error.propagated', 'error.cascade') AS er, error_type, coalesce(downstream_impact, false) AS im, data_size AS sz, schema_mismatch AS mm, data IS NULL AS nd, latency_ms AS la, condition_result AS co FROM ee "
        "UNION ALL SELECT repo_id, run_id, edge_id, true, error_type, impact, NULL, false, true, NULL, NULL FROM syn), "
        "m AS (SELECT repo_id, edge_id, count(*) AS n, count(DISTINCT run_id) AS r, avg(sz) AS sz, count(*) FILTER (mm) AS mm, count(*) FILTER (nd) AS nd, count(*) FILTER (er) AS er, string_agg(DISTINCT error_type, ',' ORDER BY error_type) FILTER (er) AS et, count(*) FILTER (er AND im) AS im, avg(la) AS la, avg(CAST(co AS INT)) AS cr FROM x GROUP BY ALL) "
        "SELECT e.repo_id, e.edge_id, source, target, edge_type, coalesce(n, 0) AS traversal_count, round(coalesce(r, 0) / total_runs, 6) AS activation_rate, n IS NULL AS never_activated, round(coalesce(sz, 0), 6) AS avg_data_size_bytes, coalesce(mm, 0) AS schema_mismatch_count, "
        "coalesce(nd, 0) AS null_data_count, coalesce(er, 0) AS errors_traversed, coalesce(et, '') AS error_types, coalesce(im, 0) AS downstream_impact, round(coalesce(la, 0), 6) AS latency_contribution_ms, round(cr, 6) AS condition_true_rate, round(1 - cr, 6) AS condition_false_rate "
        "FROM edges e JOIN runs USING (repo_id) LEFT JOIN m USING (repo_id, edge_id)", "evl", "nodes", "edges")),
    Query("e16_dead_reason_texts", lambda c: O.dead_reason_text(O.edge_validation(c.edges, c.events)).select("repo_id", "edge_id", "dead_reason_text"), W(
        "WITH " + VAL + "SELECT repo_id, edge_id, CASE dead_reason WHEN 'source_never_activated' THEN source || ' never ran' WHEN 'target_never_activated' THEN target || ' never ran' WHEN 'shared_state_not_used' THEN 'both ends ran, the state between them stayed untouched' WHEN 'guardrail_never_reached' THEN 'no run reached ' || target "
        "WHEN 'conditional_branch_not_taken' THEN 'the router sent every run elsewhere' WHEN 'path_not_chosen' THEN 'both ends ran without a handover' END AS dead_reason_text FROM val", "ev", "edges")),
    Query("e15_edge_validation", lambda c: r6(O.edge_validation(c.edges, c.events)), W(
        "WITH " + VAL + "SELECT repo_id, edge_id, source, target, edge_type, activation_count, round(activation_rate, 6) AS activation_rate, dead_reason FROM val", "ev", "edges")),
    Query("e15_activation_by_type", lambda c: r6(O.activation_by_type(O.edge_validation(c.edges, c.events))), W(
        "WITH " + VAL + "SELECT repo_id, edge_type, count(*) AS edges, round(count(*) FILTER (activation_count > 0) / count(*), 6) AS activated_share FROM val GROUP BY ALL", "ev", "edges")),
    Query("e16_activation_pairs", lambda c: O.activation_pairs(c.events), W("WITH " + PAIRS.rstrip(", ") + " SELECT * FROM pairs", "ev")),
    Query("e18_node_activation", lambda c: r6(O.node_activation(c.nodes, c.events)), W(
        "WITH " + RUNS + f"seen AS (SELECT DISTINCT repo_id, run_id, ref FROM (SELECT repo_id, run_id, coalesce(nullif(source_name, ''), nullif(source_id, '')) AS ref FROM ev WHERE event_type IN {s_in(NODE_ACTIVITY)} UNION ALL "
        f"SELECT repo_id, run_id, coalesce(nullif(target_name, ''), nullif(target_id, '')) FROM ev WHERE event_type IN {s_in(NODE_ACTIVITY)}) WHERE ref IS NOT NULL), "
        f"hit AS (SELECT r.repo_id, r.ref, arg_min(n.node_id, n.node_ord) AS node_id FROM (SELECT DISTINCT repo_id, ref FROM seen) r JOIN nodes n ON r.repo_id = n.repo_id AND (contains({s_norm('r.ref')}, {s_norm(s_strip('n.node_id'))}) OR contains({s_norm(s_strip('n.node_id'))}, {s_norm('r.ref')})) GROUP BY ALL), "
        "er AS (SELECT DISTINCT run_id FROM ev WHERE event_type LIKE 'error.%'), a AS (SELECT repo_id, node_id, count(DISTINCT run_id) AS ra, count(DISTINCT run_id) FILTER (run_id NOT IN (SELECT run_id FROM er)) AS calm FROM seen JOIN hit USING (repo_id, ref) GROUP BY ALL), "
        "z AS (SELECT n.repo_id, n.node_id, coalesce(ra, 0) AS runs_active, coalesce(calm, 0) AS calm, coalesce(ra, 0) / total_runs AS rate FROM nodes n JOIN runs USING (repo_id) LEFT JOIN a USING (repo_id, node_id)) "
        "SELECT repo_id, node_id, runs_active, round(rate, 6) AS activation_rate, CASE WHEN rate > 0.95 THEN 'always_active' WHEN rate > 0 THEN 'conditional' ELSE 'never_active' END AS category, "
        "CASE WHEN rate > 0 AND rate <= 0.95 THEN CASE WHEN calm = 0 THEN 'error_triggered' ELSE 'input_dependent' END END AS inferred_condition FROM z", "ev", "nodes")),
    Query("e21_input_groups", lambda c: O.input_groups(c.events), W("SELECT repo_id, run_id, coalesce(arg_min(input_hash, timestamp_ns) FILTER (input_hash IS NOT NULL), run_id) AS input_group FROM ev GROUP BY repo_id, run_id", "ev")),
    Query("e22_determinism", lambda c: r6(O.determinism(c.nodes, c.events, ref_map(c))), W(
        "WITH " + NB + "ig AS (SELECT repo_id, run_id, coalesce(arg_min(input_hash, timestamp_ns) FILTER (input_hash IS NOT NULL), run_id) AS g FROM ev GROUP BY repo_id, run_id), "
        f"k AS (SELECT repo_id, node_id, run_id, count(*) AS k FROM ne WHERE event_type IN {s_in(ACTIVATION_START)} GROUP BY ALL), "
        "grid AS (SELECT n.repo_id, n.node_id, ig.run_id, g, coalesce(k, 0) AS k FROM nodes n JOIN ig USING (repo_id) LEFT JOIN k ON k.repo_id = n.repo_id AND k.node_id = n.node_id AND k.run_id = ig.run_id), "
        "pr AS (SELECT a.repo_id, a.node_id, avg(CASE WHEN (a.k > 0) = (b.k > 0) THEN 1 ELSE 0 END) AS pa, avg(CASE WHEN a.k = b.k THEN 1 ELSE 0 END) AS pk FROM grid a JOIN grid b ON a.repo_id = b.repo_id AND a.node_id = b.node_id AND a.g = b.g AND a.run_id < b.run_id GROUP BY ALL), "
        "gm AS (SELECT repo_id, node_id, g, avg(k) AS m FROM grid GROUP BY ALL), cv AS (SELECT repo_id, node_id, CASE WHEN count(*) >= 2 THEN stddev_pop(m) / greatest(avg(m), 1e-9) ELSE 0 END AS cv FROM gm GROUP BY ALL) "
        "SELECT n.repo_id, n.node_id, round(pa, 6) AS same_input_activation_consistency, round(pk, 6) AS same_input_path_consistency, round(cv, 6) AS cross_input_variance FROM nodes n JOIN runs USING (repo_id) JOIN cv USING (repo_id, node_id) LEFT JOIN pr USING (repo_id, node_id) WHERE total_runs >= 2", "evl", "nodes")),
    Query("e23_path_steps", lambda c: O.path_steps(c.events, ref_map(c), c.edges), W(
        "WITH " + REFMAP + EVR + EE + "st AS (SELECT repo_id, run_id, timestamp_ns, edge_id, edge_ord, min(CAST(event_id AS VARCHAR)) AS eid FROM ee GROUP BY ALL) "
        "SELECT repo_id, run_id, row_number() OVER (PARTITION BY repo_id, run_id ORDER BY timestamp_ns, eid, edge_ord) - 1 AS position, timestamp_ns, edge_id FROM st", "evl", "nodes", "edges")),
    Query("e24_path_analysis", lambda c: r6(O.path_analysis(O.path_steps(c.events, ref_map(c), c.edges), c.events)), W(
        "WITH " + REFMAP + EVR + EE + "st AS (SELECT repo_id, run_id, timestamp_ns, edge_id, edge_ord, min(CAST(event_id AS VARCHAR)) AS eid FROM ee GROUP BY ALL), "
        "sg AS (SELECT r.repo_id, r.run_id, string_agg(edge_id, '>' ORDER BY timestamp_ns, eid, edge_ord) AS sig FROM (SELECT DISTINCT repo_id, run_id FROM ev) r LEFT JOIN st USING (repo_id, run_id) GROUP BY ALL), "
        "c AS (SELECT repo_id, sig, count(*) AS n FROM sg GROUP BY ALL) SELECT repo_id, count(*) AS distinct_paths, round(max(n) / sum(n), 6) AS dominant_path_frequency FROM c GROUP BY repo_id", "evl", "nodes", "edges")),
    Query("e24_conditional_edges", lambda c: r6(O.conditional_edges(O.path_steps(c.events, ref_map(c), c.edges), c.events, c.edges)), W(
        "WITH " + REFMAP + EVR + EE + RUNS.rstrip(", ") + " SELECT ee.repo_id, ee.edge_id, g.source AS divergence_node, round(count(DISTINCT run_id) / any_value(total_runs), 6) AS activation_rate FROM ee JOIN runs USING (repo_id) JOIN edges g ON g.repo_id = ee.repo_id AND g.edge_id = ee.edge_id "
        "GROUP BY ee.repo_id, ee.edge_id, g.source HAVING count(DISTINCT run_id) < any_value(total_runs)", "evl", "nodes", "edges")),
    Query("e25_failure_impacts", lambda c: r6(O.failure_impacts(c.nodes, c.events), 3), W(
        "WITH " + _FAIL_SQL + "SELECT repo_id, node_id, count(*) AS failures, CAST(sum(d3) AS BIGINT) AS downstream_degradation_count, bool_or(oth > 0) AS cascade_to_other_agents, bool_or(rts IS NOT NULL) AS recovery_observed, "
        "round(coalesce(avg((rts - ts) / 1e6) FILTER (rts > ts), 0), 3) AS avg_recovery_time_ms, count(*) FILTER (otk > 0 AND oe2 = 0) AS silent_degradation_count FROM j GROUP BY repo_id, node_id", "ev", "nodes")),
    Query("e26_cascades", lambda c: O.cascades(behavior(c), closure(c)), W(
        "WITH " + REACH + NB + f"bad AS (SELECT repo_id, node_id, count(*) AS n FROM ne WHERE {S_ERR} OR {_BAD_END} GROUP BY ALL) "
        "SELECT o.repo_id, o.node_id AS origin_node, o.n AS origin_errors, coalesce(max(f.depth) FILTER (b.n > 0), 0) AS cascade_depth, count(b.n) AS nodes_affected, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS total_downstream_errors "
        "FROM bad o LEFT JOIN far f ON f.repo_id = o.repo_id AND f.origin = o.node_id LEFT JOIN bad b ON b.repo_id = f.repo_id AND b.node_id = f.node GROUP BY o.repo_id, o.node_id, o.n", "evl", "nodes", "edges", recursive=True)),
    Query("e26_cascade_summary", lambda c: r6(O.cascade_summary(O.cascades(behavior(c), closure(c)))), W(
        "WITH " + REACH + NB + f"bad AS (SELECT repo_id, node_id, count(*) AS n FROM ne WHERE {S_ERR} OR {_BAD_END} GROUP BY ALL), "
        "cs AS (SELECT o.repo_id, o.node_id, coalesce(max(f.depth) FILTER (b.n > 0), 0) AS d FROM bad o LEFT JOIN far f ON f.repo_id = o.repo_id AND f.origin = o.node_id LEFT JOIN bad b ON b.repo_id = f.repo_id AND b.node_id = f.node GROUP BY ALL) "
        "SELECT repo_id, max(d) AS max_cascade_depth, round(avg(d), 6) AS avg_cascade_depth, round(count(*) FILTER (d > 0) / count(*), 6) AS cascading_failure_rate FROM cs GROUP BY repo_id", "evl", "nodes", "edges", recursive=True)),
    Query("e1_unmapped_events", lambda c: O.unmapped_counts(c.events, ref_map(c), c.edges), W(
        "WITH " + REFMAP + EVR + NE + EE + f"q1 AS (SELECT repo_id, count(*) AS n, count(*) FILTER (event_type IN {s_in(list(EVENT_EDGES))} OR target_id IS NOT NULL) AS el FROM ev GROUP BY ALL) "
        "SELECT repo_id, n - coalesce((SELECT count(DISTINCT event_id) FROM ne WHERE ne.repo_id = q1.repo_id), 0) AS unmapped_node_events, el - coalesce((SELECT count(DISTINCT event_id) FROM ee WHERE ee.repo_id = q1.repo_id), 0) AS unmapped_edge_events FROM q1", "evl", "nodes", "edges")),
]
