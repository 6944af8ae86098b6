"""Registered queries: run and repository roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.operators import rollup as R
from spoor.plans.corpus import Corpus, Query, r6
from spoor.sources.tables import with_ctes as W

_ERR = "event_type IN ('error.occurred', 'error.propagated', 'error.cascade', 'tool.call_failure')"
_PAIRS = (
    "SELECT e.repo_id, e.run_id, e.source_id, e.source_name, e.event_type, e.timestamp_ns - s.timestamp_ns AS lat FROM evl e JOIN evl s "
    "ON e.repo_id = s.repo_id AND e.run_id = s.run_id AND e.parent_id = s.event_id AND s.timestamp_ns <= e.timestamp_ns "
)
_REC = (
    "WITH p AS (" + _PAIRS + "WHERE s.event_type = 'llm.call_start' AND e.event_type = 'llm.call_end'), "
    "lat AS (SELECT repo_id, run_id, sum(lat) AS lsum, count(*) AS latency_count FROM p GROUP BY ALL), "
    "base AS (SELECT repo_id, run_id, count(*) AS total_events, min(timestamp_ns) AS start_ns, max(timestamp_ns) AS end_ns, "
    f"count(*) FILTER ({_ERR}) AS total_errors, coalesce(max(stack_depth) FILTER ({_ERR}), 0) AS max_propagation_depth, "
    "count(*) FILTER (event_type LIKE 'delegation.%') AS delegations, count(*) FILTER (event_type = 'state.access') AS state_access_count, "
    "count(*) FILTER (event_type = 'routing.decision') AS routing_decision_count, "
    "count(*) FILTER (event_type = 'llm.call_start') AS llm_calls, "
    "CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS total_tokens FROM evl GROUP BY ALL), "
    "rec AS (SELECT base.*, (end_ns - start_ns) / 1e6 AS duration_ms, coalesce(lsum, 0) AS lsum, coalesce(lsum / latency_count / 1e6, 0) AS avg_latency_ms, end_ns - start_ns AS dns, "
    "coalesce(latency_count, 0) AS latency_count FROM base LEFT JOIN lat USING (repo_id, run_id)) "
)
_REPO = (
    "SELECT repo_id, count(*) AS num_runs, CAST(sum(total_events) AS BIGINT) AS total_events, round(sum(total_events) / count(*), 5) AS avg_events_per_run, "
    "round(coalesce(min(dns) FILTER (dns > 0) / 1e6, 0), 5) AS min_duration_ms, round(coalesce(max(dns) FILTER (dns > 0) / 1e6, 0), 5) AS max_duration_ms, "
    "round(coalesce(avg(dns) FILTER (dns > 0) / 1e6, 0), 5) AS avg_duration_ms, CAST(sum(llm_calls) AS BIGINT) AS llm_calls, "
    "CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(coalesce(sum(lsum) / nullif(sum(latency_count), 0) / 1e6, 0), 5) AS avg_latency_ms, "
    "CAST(sum(total_errors) AS BIGINT) AS total_errors, max(max_propagation_depth) AS max_propagation_depth, count(*) FILTER (total_errors > 0) AS runs_with_errors FROM rec GROUP BY repo_id"
)


def flagship(c: Corpus):
    return r6(R.repo_summaries(R.run_records(c.events)), 5)


def _full_name(c: Corpus):
    """Last two path parts of a URL (page URLs stand in for repository URLs)."""
    url = F.regexp_replace(F.split(F.col("url"), "[?#]").getItem(0), "/+$", "")
    parts = F.split(url, "/")
    return c.table("pages").select("page_id", F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.element_at(parts, -1)).alias("full_name"))


_MAP_SRC = "coalesce(nullif(source_name, ''), nullif(source_id, ''), '{d}')"

QUERIES = [
    Query("b1_run_records", lambda c: r6(R.run_records(c.events).drop("duration_ns", "latency_sum_ns")), W(
        _REC + "SELECT repo_id, run_id, total_events, start_ns, end_ns, total_errors, max_propagation_depth, delegations, state_access_count, "
        "routing_decision_count, round(duration_ms, 6) AS duration_ms, llm_calls, total_tokens, round(avg_latency_ms, 6) AS avg_latency_ms, latency_count FROM rec", "evl")),
    Query("b2_event_type_histogram", lambda c: R.type_counts(c.events), W("SELECT repo_id, run_id, event_type, count(*) AS events FROM ev GROUP BY ALL", "ev")),
    Query("b3_timeline", lambda c: r6(R.timeline(c.events)), W(
        "SELECT repo_id, run_id, min(timestamp_ns) AS start_ns, max(timestamp_ns) AS end_ns, max(timestamp_ns) - min(timestamp_ns) AS duration_ns, "
        "round((max(timestamp_ns) - min(timestamp_ns)) / 1e6, 6) AS duration_ms FROM ev GROUP BY ALL", "ev")),
    Query("b4_agent_activations", lambda c: R.agent_activations(c.events), W(
        f"SELECT repo_id, run_id, {_MAP_SRC.format(d='unknown_agent')} AS agent, count(*) FILTER (event_type IN ('agent.task_start', 'execution.start')) AS start_events, "
        f"count(*) FILTER (event_type = 'agent.task_end') AS end_events, count(*) FILTER ({_ERR}) AS error_events, "
        "count(*) FILTER (event_type IN ('agent.task_start', 'execution.start')) AS activation_count FROM ev "
        f"WHERE event_type IN ('agent.task_start', 'execution.start', 'agent.task_end') OR {_ERR} GROUP BY ALL", "ev")),
    Query("b5_tool_invocations", lambda c: R.tool_invocations(c.events), W(
        "SELECT repo_id, run_id, coalesce(tool_name, 'unknown_tool') AS tool, count(*) FILTER (event_type = 'tool.invoked') AS invocation_count, "
        "count(*) FILTER (event_type = 'tool.completed' AND status = 'success') AS success_count, "
        "count(*) FILTER ((event_type = 'tool.completed' AND status <> 'success') OR event_type = 'tool.call_failure') AS failure_count "
        "FROM ev WHERE event_type LIKE 'tool.%' GROUP BY ALL", "ev")),
    Query("b6_llm_calls", lambda c: r6(R.llm_calls(c.events).drop("latency_sum_ns")), W(
        _REC + "SELECT repo_id, run_id, llm_calls, total_tokens, round(avg_latency_ms, 6) AS avg_latency_ms, latency_count FROM rec "
        "WHERE EXISTS (SELECT 1 FROM evl WHERE evl.run_id = rec.run_id AND event_type IN ('llm.call_start', 'llm.call_end'))", "evl")),
    Query("b7_error_histogram", lambda c: R.error_types(c.events), W(
        f"SELECT repo_id, run_id, coalesce(error_type, event_type) AS error_type, count(*) AS errors, max(stack_depth) AS max_depth FROM ev WHERE {_ERR} GROUP BY ALL", "ev")),
    Query("b8_delegation_chain", lambda c: R.delegation_chain(c.events), W(
        f"SELECT repo_id, run_id, CAST(event_id AS VARCHAR) AS event_id, timestamp_ns, event_type, {_MAP_SRC.format(d='unknown')} AS delegator, "
        "coalesce(nullif(target_name, ''), nullif(target_id, ''), 'unknown') AS delegate, "
        "row_number() OVER (PARTITION BY repo_id, run_id ORDER BY timestamp_ns, CAST(event_id AS VARCHAR)) - 1 AS position "
        "FROM ev WHERE event_type LIKE 'delegation.%'", "ev")),
    Query("b9_runs_without_events", lambda c: R.run_records(
        c.events.filter("event_type = 'external.call'"), c.events.select("repo_id", "run_id")).select("repo_id", "run_id", "total_events", "llm_calls", "total_errors"), W(
        "SELECT repo_id, run_id, count(*) FILTER (event_type = 'external.call') AS total_events, CAST(0 AS BIGINT) AS llm_calls, CAST(0 AS BIGINT) AS total_errors FROM ev GROUP BY ALL", "ev")),
    Query("b10_repo_summaries", flagship, W(_REC + _REPO, "evl")),
    Query("b10_repo_tools", lambda c: R.roll_tall(R.tool_invocations(c.events), "tool"), W(
        "SELECT repo_id, tool_name AS tool, count(*) FILTER (event_type = 'tool.invoked') AS invocation_count, "
        "count(*) FILTER (event_type = 'tool.completed' AND status = 'success') AS success_count, "
        "count(*) FILTER ((event_type = 'tool.completed' AND status <> 'success') OR event_type = 'tool.call_failure') AS failure_count "
        "FROM ev WHERE event_type LIKE 'tool.%' GROUP BY ALL", "ev")),
    Query("b12_nodes_seen", lambda c: R.nodes_seen(c.events), W(
        "SELECT DISTINCT repo_id, node_id FROM (SELECT repo_id, source_id AS node_id FROM ev UNION ALL SELECT repo_id, target_id FROM ev) WHERE node_id <> ''", "ev")),
    Query("b15_url_full_name", _full_name, (
        "SELECT page_id, concat_ws('/', CASE WHEN len(parts) >= 2 THEN parts[-2] END, parts[-1]) AS full_name FROM (SELECT page_id, "
        "string_split(regexp_replace(regexp_extract(url, '^[^?#]*'), '/+$', ''), '/') AS parts FROM pages)")),
    Query("b31_collection_stats", lambda c: R.collection_stats(R.run_records(c.events)), W(
        _REC + "SELECT count(*) AS runs, count(DISTINCT repo_id) AS repos, CAST(sum(total_events) AS BIGINT) AS events, CAST(sum(total_errors) AS BIGINT) AS errors FROM rec", "evl")),
]
