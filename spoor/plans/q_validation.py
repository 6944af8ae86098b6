"""Registered queries: validation, audits, run status and gates, corpus counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.operators import quality as C
from spoor.operators import rollup as R
from spoor.operators import validation as A
from spoor.plans.corpus import Corpus, Query, r6
from spoor.sources import jsonl as J
from spoor.sources.tables import with_ctes as W

# orders stand in for the run table: one run per order, its line items are its events
_RUN_COLS = {
    "status": "CASE o_orderpriority WHEN '1-URGENT' THEN 'SUCCESS' WHEN '2-HIGH' THEN 'PARTIAL_SUCCESS' WHEN '3-MEDIUM' THEN 'TIMEOUT_NO_EVENTS' WHEN '4-NOT SPECIFIED' THEN 'NO_EVENTS' ELSE 'RUNTIME_ERROR' END",
    "exit_code": "CASE p % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 124 END",
    "stderr": "CASE p % 9 WHEN 0 THEN 'ModuleNotFoundError: No module named x' WHEN 1 THEN 'FileNotFoundError: main.py' WHEN 2 THEN 'openai: Rate Limit' WHEN 3 THEN 'sitecustomize not loaded' WHEN 4 THEN 'Traceback: boom' ELSE '' END",
    "has_interaction": "p % 5 > 0",
}


def run_table(c: Corpus):
    n = c.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("events"))
    o = c.table("orders").withColumn("p", F.expr("CAST(round(o_totalprice * 100) AS BIGINT)")).join(n, "o_orderkey", "left").fillna(0, ["events"])
    return o.select(F.concat(F.lit("repo_"), "o_custkey").alias("repo_id"), F.concat(F.lit("run_"), "o_orderkey").alias("run_id"), "events", *[F.expr(t).alias(k) for k, t in _RUN_COLS.items()])


_RT = (
    "rt AS (SELECT concat('repo_', o_custkey) AS repo_id, concat('run_', o_orderkey) AS run_id, events, " + ", ".join(f"{t} AS {k}" for k, t in _RUN_COLS.items())
    + " FROM (SELECT o.*, CAST(round(o_totalprice * 100) AS BIGINT) AS p, coalesce(n, 0) AS events FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)), "
)
_CLS = _RT + (
    "cl AS (SELECT *, CASE WHEN p = 'd' THEN 'DEPENDENCY_FAILURE' WHEN p = 'e' THEN 'ENTRY_POINT_FAILURE' WHEN p = 'm' THEN 'MODEL_FAILURE' WHEN p = 'i' THEN 'INSTRUMENTATION_FAILURE' WHEN exit_code = 0 AND events >= 10 AND has_interaction THEN 'SUCCESS' "
    "WHEN exit_code = 0 OR events > 0 THEN 'PARTIAL_SUCCESS' ELSE 'CRASH' END AS classified FROM (SELECT *, CASE WHEN stderr LIKE 'Module%' THEN 'd' WHEN stderr LIKE 'FileNot%' THEN 'e' WHEN stderr LIKE 'openai%' THEN 'm' WHEN stderr LIKE 'sitecustom%' THEN 'i' ELSE '' END AS p FROM rt)), "
)
_CAT = _RT + (
    "ca AS (SELECT *, CASE WHEN status = 'TIMEOUT_NO_EVENTS' OR exit_code = 124 THEN CASE WHEN events > 0 THEN 'PARTIAL_SUCCESS' ELSE 'TIMEOUT' END WHEN events = 0 AND stderr LIKE 'openai%' THEN 'MODEL_FAILURE' "
    "WHEN status IN ('SUCCESS', 'PARTIAL_SUCCESS') THEN CASE WHEN events >= 10 AND has_interaction THEN 'SUCCESS' WHEN events > 0 THEN 'PARTIAL_SUCCESS' ELSE 'INSTRUMENTATION_FAILURE' END WHEN status = 'NO_EVENTS' THEN 'INSTRUMENTATION_FAILURE' "
    "ELSE CASE WHEN events > 0 THEN 'PARTIAL_SUCCESS' ELSE 'CRASH' END END AS category FROM rt), "
)
_IDS = "SELECT DISTINCT repo_id, source_id AS node_id FROM ev WHERE source_id <> ''"


def event_lines(c: Corpus):
    """Every event as one JSON line, with a bad line after each error cascade, to exercise the reader."""
    line = F.to_json(F.struct("event_id", "timestamp_ns", "run_id", "repo_id", "framework", "event_type", "source_node", "target_node", "payload"))
    return c.events.select(F.col("repo_id").alias("file_stem"), F.explode(F.array_compact(F.array(line, F.when(F.col("event_type") == "error.cascade", F.substring(line, 1, 40))))).alias("line"))


QUERIES = [
    Query("a1_a2_parsed_lines", lambda c: J.parse_events(event_lines(c)).groupBy(F.col("file_stem").alias("repo_id"), F.coalesce("event_type", F.lit("?")).alias("kind"), "valid", "corrupt").agg(F.count(F.lit(1)).alias("lines")), W(
        "SELECT repo_id, event_type AS kind, true AS valid, false AS corrupt, count(*) AS lines FROM ev GROUP BY ALL UNION ALL SELECT repo_id, '?', false, true, count(*) FROM ev WHERE event_type = 'error.cascade' GROUP BY ALL", "ev")),
    Query("a4_events_per_run", lambda c: c.events.groupBy("repo_id", F.coalesce("run_id", F.lit("unknown")).alias("run_id")).agg(F.count(F.lit(1)).alias("events")), W("SELECT repo_id, run_id, count(*) AS events FROM ev GROUP BY ALL", "ev")),
    Query("a16_compare_ids", lambda c: r6(A.compare_ids(c.nodes, c.events.select("repo_id", F.col("source_node.node_id").alias("node_id")).filter("node_id <> ''"))), W(
        f"WITH b AS ({_IDS}), j AS (SELECT coalesce(n.repo_id, b.repo_id) AS repo_id, n.node_id AS s, b.node_id AS h FROM nodes n FULL JOIN b ON n.repo_id = b.repo_id AND n.node_id = b.node_id), "
        "a AS (SELECT repo_id, count(*) FILTER (s IS NOT NULL AND h IS NOT NULL) AS matched, count(*) FILTER (h IS NULL) AS structural_only, count(*) FILTER (s IS NULL) AS behavioral_only, count(*) AS t FROM j GROUP BY 1) "
        "SELECT repo_id, matched, structural_only, behavioral_only, round(matched / t, 6) AS match_rate, matched / t >= 0.5 AND behavioral_only = 0 AS compatible FROM a", "ev", "nodes")),
    Query("a17_behavioral_class", lambda c: A.behavioral_class(c.events), W("SELECT repo_id, run_id, CASE WHEN bool_or(event_type LIKE 'agent.%') AND bool_or(event_type LIKE 'llm.%') THEN 'FULL_BEHAVIORAL' WHEN bool_or(event_type LIKE 'llm.%') THEN 'LLM_ONLY' ELSE 'NO_BEHAVIORAL_DATA' END AS behavioral_class FROM ev GROUP BY ALL", "ev")),
    Query("a18_file_counters", lambda c: A.file_counters(J.parse_events(event_lines(c)), ["file_stem"]).withColumnRenamed("file_stem", "repo_id"), W(
        "SELECT repo_id, count(*) + count(*) FILTER (event_type = 'error.cascade') AS event_count, count(*) FILTER (event_type = 'error.cascade') AS corrupt_lines, CAST(0 AS BIGINT) AS double_prefix, count(*) FILTER (event_type = 'llm.call_start') AS llm_starts, count(*) FILTER (event_type = 'llm.call_end') AS llm_ends, "
        "count(*) FILTER (event_type LIKE 'agent.%') AS agent_events, count(*) FILTER (event_type = 'llm.call_start' AND user_message IS NOT NULL) AS has_user_message, count(*) FILTER (event_type = 'llm.call_end' AND preview IS NOT NULL) AS has_output FROM ev GROUP BY repo_id", "ev")),
    Query("a19_corpus_quality", lambda c: r6(A.corpus_quality(c.nodes.groupBy("repo_id").agg(F.lit("scan_1").alias("scan_id"), F.lit(True).alias("has_events"), (F.min("framework") != "autogen").alias("has_metadata"), F.lit(0).alias("double_prefix")), A.behavioral_class(c.events))), W(
        "WITH b AS (SELECT repo_id, bool_or(event_type LIKE 'llm.%') AS l FROM ev GROUP BY 1), r AS (SELECT repo_id, min(framework) <> 'autogen' AS m FROM nodes GROUP BY 1) SELECT count(*) AS repos_total, count(*) AS repos_with_events, count(*) FILTER (m) AS repos_with_metadata, count(*) FILTER (l) AS behavioral_repos, "
        "CAST(0 AS BIGINT) AS double_prefix, CAST(1 AS BIGINT) AS scan_ids, round(30 + 20 * count(*) FILTER (m) / count(*) + 30 * count(*) FILTER (l) / count(*) + 20, 6) AS data_quality_score FROM r LEFT JOIN b USING (repo_id)", "ev", "nodes")),
    Query("a20_record_compatibility", lambda c: A.record_compatibility(c.events), W(
        "WITH t AS (SELECT repo_id, list(DISTINCT event_type) AS l FROM ev GROUP BY 1), f AS (SELECT repo_id, list_has_any(l, " + repr(A.EDGE_SECTION) + ") AS edge_validation, list_has_any(l, " + repr(A.NODE_SECTION) + ") AS node_activation, len(list_intersect(l, " + repr(A.DIVERSITY_SECTION) + ")) >= 3 AS behavioral_diversity FROM t) "
        "SELECT *, CASE CAST(edge_validation AS INT) + CAST(node_activation AS INT) + CAST(behavioral_diversity AS INT) WHEN 3 THEN 'YES' WHEN 0 THEN 'NO' ELSE 'PARTIAL' END AS compatible FROM f", "ev")),
    Query("a21_run_files", lambda c: A.run_files(c.events), W("WITH p AS (SELECT repo_id, run_id, count(*) AS n FROM ev GROUP BY ALL) SELECT repo_id, count(*) AS runs, CAST(sum(n) AS BIGINT) AS events, min(n) AS smallest_run, max(n) AS largest_run, count(*) >= 3 AS enough_for_activation_rate FROM p GROUP BY 1", "ev")),
    Query("a22_trace_audit", lambda c: A.trace_audit(c.events), W(
        "SELECT repo_id, count(*) AS events, CAST(0 AS BIGINT) AS missing_fields, count(*) FILTER (event_type NOT IN (" + ", ".join(f"'{t}'" for t in A.KNOWN_TYPES) + ")) AS unknown_types, CAST(0 AS BIGINT) AS duplicate_ids FROM ev GROUP BY 1", "ev")),
    Query("a22_content_flows", lambda c: A.content_flows(c.events), W(
        "SELECT DISTINCT s.repo_id, s.run_id, s.input_source AS producer, s.source_id AS consumer FROM ev s JOIN ev e ON e.run_id = s.run_id AND e.source_id = s.input_source AND e.event_type = 'agent.task_end' AND e.output_hash IS NOT NULL WHERE s.event_type = 'agent.task_start' AND s.source_id <> ''", "ev")),
    Query("a22_duplicate_texts", lambda c: c.table("documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "SELECT sha256(text) AS hash, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1"),
    Query("a24_trace_profile", lambda c: r6(A.trace_profile(c.events)), W(
        "SELECT repo_id, count(*) AS total_events, bool_or(preview IS NOT NULL) AS has_output, coalesce(bool_or(input_tokens > 0 OR output_tokens > 0), false) AS has_tokens, bool_or(event_type = 'routing.decision') AS has_edge_events, bool_or(event_type LIKE 'delegation.%') AS has_delegation_events, "
        "count(DISTINCT nullif(source_id, '')) AS unique_source_nodes, count(DISTINCT nullif(source_name, '')) AS unique_agents, round((CAST(bool_or(preview IS NOT NULL) AS INT) + CAST(coalesce(bool_or(user_message IS NOT NULL), false) AS INT) + CAST(coalesce(bool_or(input_tokens > 0 OR output_tokens > 0), false) AS INT)) / 4, 6) AS io_completeness FROM ev GROUP BY repo_id", "ev")),
    Query("a32_first_payloads", lambda c: A.first_payloads(c.events).select("repo_id", "event_type", "event_id"), W("SELECT repo_id, event_type, CAST(arg_min(event_id, timestamp_ns) AS VARCHAR) AS event_id FROM ev GROUP BY ALL", "ev")),
    Query("a12_field_coverage", lambda c: r6(A.coverage(c.table("documents").join(c.table("labels"), "doc_id", "left").select("doc_id", "lang", "source", "text", "quality", "toxic"), {"text": ["text", "lang"], "label": ["quality", "toxic"]}).select("doc_id", "coverage_pct", "text_ready", "label_ready")), (
        "SELECT doc_id, CAST((CASE WHEN text <> '' THEN 1 ELSE 0 END + CASE WHEN lang <> '' THEN 1 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN toxic IS NOT NULL THEN 1 ELSE 0 END) * 25 AS DOUBLE) AS coverage_pct, "
        "coalesce(text <> '' AND lang <> '', false) AS text_ready, quality IS NOT NULL AND toxic IS NOT NULL AS label_ready FROM documents LEFT JOIN labels USING (doc_id)")),
    Query("b11_execution_metadata", lambda c: r6(R.execution_metadata(run_table(c).select("repo_id", "status", "events", F.lit("crewai").alias("framework"), F.col("exit_code").alias("duration_ms")))), W(
        "WITH " + _RT.rstrip(", ") + " SELECT repo_id, count(*) AS num_runs, CAST(sum(events) AS BIGINT) AS total_events, round(count(*) FILTER (status IN ('SUCCESS', 'PARTIAL_SUCCESS')) / count(*), 6) AS success_rate, round(avg(exit_code), 6) AS mean_duration_ms, 'crewai' AS frameworks FROM rt GROUP BY 1", "users")),
    Query("b13_llm_attribution", lambda c: R.llm_attribution(c.events), W(
        "WITH k AS (SELECT *, CAST(event_id AS VARCHAR) AS eid, last_value(CASE WHEN event_type = 'agent.task_start' THEN coalesce(nullif(source_id, ''), nullif(source_name, ''), 'agent') WHEN event_type = 'agent.task_end' THEN '' END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY timestamp_ns, CAST(event_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open "
        "FROM ev WHERE event_type IN ('agent.task_start', 'agent.task_end', 'llm.call_end')), s AS (SELECT run_id, source_id AS n, min(timestamp_ns) AS since FROM ev WHERE event_type = 'agent.task_start' AND source_id <> '' GROUP BY ALL) "
        "SELECT k.repo_id, k.run_id, eid AS event_id, coalesce(CASE WHEN stack_top IS NOT NULL THEN CASE WHEN a.since <= timestamp_ns THEN src_struct WHEN b.since <= timestamp_ns THEN stack_top END END, nullif(open, ''), '') AS agent_key, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens "
        "FROM k LEFT JOIN s a ON a.run_id = k.run_id AND a.n = src_struct LEFT JOIN s b ON b.run_id = k.run_id AND b.n = stack_top WHERE event_type = 'llm.call_end'", "ev")),
    Query("b13_agent_tasks", lambda c: R.agent_tasks(c.events).select("repo_id", "run_id", "task_id", "agent_key", "status"), W(
        "WITH k AS (SELECT *, coalesce(nullif(source_id, ''), nullif(source_name, ''), 'agent') AS ak, CAST(event_id AS VARCHAR) AS eid FROM ev WHERE event_type IN ('agent.task_start', 'agent.task_end')), "
        "g AS (SELECT *, last_value(CASE WHEN event_type = 'agent.task_start' THEN eid END IGNORE NULLS) OVER (PARTITION BY run_id, ak ORDER BY timestamp_ns, eid ROWS UNBOUNDED PRECEDING) AS tid FROM k), "
        "e AS (SELECT run_id, ak, tid, arg_max(status, timestamp_ns) AS status FROM g WHERE event_type = 'agent.task_end' AND tid IS NOT NULL GROUP BY ALL) "
        "SELECT k.repo_id, k.run_id, k.eid AS task_id, k.ak AS agent_key, coalesce(e.status, '') AS status FROM k LEFT JOIN e ON e.run_id = k.run_id AND e.ak = k.ak AND e.tid = k.eid WHERE event_type = 'agent.task_start'", "ev")),
    Query("b14_first_wins", lambda c: R.first_wins(c.table("documents").select("doc_id", F.sha2("text", 256).alias("text_hash")), "text_hash", "doc_id"), "SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash FROM documents GROUP BY 2"),
    Query("b18_grade_trace", lambda c: A.grade_trace(c.events), W(
        "WITH a AS (SELECT repo_id, run_id, count(*) AS n, count(DISTINCT source_id) FILTER (source_type = 'agent' AND source_id <> '') AS ag, bool_or(event_type = 'agent.task_end' AND output_hash IS NOT NULL) AS h, bool_or(input_source IS NOT NULL) AS f, bool_or(event_type = 'llm.call_end') AS l, bool_or(event_type <> 'execution.start') AS m FROM ev GROUP BY ALL) "
        "SELECT repo_id, run_id, CASE WHEN ag >= 2 AND h AND f THEN 'RICH' WHEN l THEN 'BASIC' WHEN NOT m THEN 'EMPTY' WHEN n >= 3 THEN 'BASIC' ELSE 'EMPTY' END AS grade FROM a", "ev")),
    Query("b19_grade_repo", lambda c: A.grade_repo(c.events), W(
        "WITH a AS (SELECT repo_id, count(DISTINCT source_id) FILTER (source_type = 'agent' AND source_id <> '') AS ag, bool_or(event_type = 'agent.task_end' AND output_hash IS NOT NULL) AS h, bool_or(input_source IS NOT NULL OR parent_node IS NOT NULL) AS f, bool_or(event_type IN ('delegation.initiated', 'tool.invoked', 'state.access', 'routing.decision')) AS r, "
        "bool_or(event_type = 'llm.call_end') AS l, bool_or(event_type LIKE 'agent.task_%') AS li, bool_or(event_type NOT IN ('execution.start', 'error.occurred', 'error.propagated')) AS m FROM ev GROUP BY ALL) SELECT repo_id, CASE WHEN ag >= 2 AND h AND f AND r THEN 'RICH' WHEN l AND li THEN 'BASIC' WHEN l THEN 'THIN' WHEN NOT m THEN 'EMPTY' ELSE 'THIN' END AS grade FROM a", "ev")),
    Query("b20_graph_topology", lambda c: A.graph_topology(c.nodes, c.edges), W(
        "SELECT repo_id, CASE WHEN coalesce((SELECT bool_or(edge_type = 'delegates_to') FROM edges e WHERE e.repo_id = n.repo_id), false) THEN 'with_delegation' WHEN (SELECT max(d) FROM (SELECT count(*) AS d FROM edges e WHERE e.repo_id = n.repo_id AND e.source LIKE 'agent_%' GROUP BY source)) > 2 THEN 'hub_and_spoke' ELSE 'sequential_5_agent' END AS topology FROM (SELECT DISTINCT repo_id FROM nodes) n", "nodes", "edges")),
    Query("b17_topology_by_tier", lambda c: R.topology_by_tier(A.graph_topology(c.nodes, c.edges), c.nodes.groupBy("repo_id").agg(F.when(F.min("framework") == "crewai", 1).when(F.min("framework") == "autogen", 2).alias("tier"))), W(
        "WITH t AS (SELECT repo_id, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = n.repo_id AND edge_type = 'delegates_to') THEN 'with_delegation' WHEN (SELECT max(d) FROM (SELECT count(*) AS d FROM edges e WHERE e.repo_id = n.repo_id AND e.source LIKE 'agent_%' GROUP BY source)) > 2 THEN 'hub_and_spoke' ELSE 'sequential_5_agent' END AS topology, framework FROM (SELECT DISTINCT repo_id, framework FROM nodes) n) "
        "SELECT topology, count(*) FILTER (framework <> 'autogen') AS tier_1, count(*) FILTER (framework = 'autogen') AS tier_2, count(*) AS total FROM t GROUP BY 1", "nodes", "edges")),
    Query("b25_multi_run_stats", lambda c: R.multi_run_stats(c.events), W("WITH p AS (SELECT repo_id, count(DISTINCT run_id) AS r FROM ev GROUP BY 1) SELECT count(*) AS repos, count(*) FILTER (r > 1) AS repos_multi_run, CAST(sum(r) AS BIGINT) AS runs_total FROM p", "ev")),
    Query("b26_score_distribution", lambda c: r6(R.score_distribution(c.table("documents").select("doc_id", F.col("n_chars"), F.length("source").alias("source_len")), ["n_chars", "source_len"]), 4), (
        "WITH l AS (SELECT 'n_chars' AS score, CAST(n_chars AS DOUBLE) AS v FROM documents UNION ALL SELECT 'source_len', length(source) FROM documents) SELECT score, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max, round(coalesce(stddev_samp(v), 0), 4) AS sd, count(*) AS n, list_sort(list(v))[count(*) // 2 + 1] AS median FROM l GROUP BY 1")),
    Query("c1_run_status", lambda c: C.classify(run_table(c)).select("run_id", "classified", "usable_for_dataset"), W("WITH " + _CLS.rstrip(", ") + " SELECT run_id, classified, classified IN ('SUCCESS', 'PARTIAL_SUCCESS') AND events >= 5 AS usable_for_dataset FROM cl", "users")),
    Query("c2_event_flags", lambda c: C.event_flags(c.events), W(
        "SELECT repo_id, run_id, count(*) AS events_emitted, bool_or(event_type LIKE 'agent.%') AS has_agent_events, bool_or(event_type LIKE 'llm.%') AS has_llm_events, bool_or(event_type LIKE 'delegation.%') AS has_delegation_events, bool_or(event_type LIKE 'error.%') AS has_error_events, bool_or(output_hash IS NOT NULL) AS has_semantic_data FROM ev GROUP BY ALL", "ev")),
    Query("c3_failures_sheet", lambda c: C.failures(C.classify(run_table(c))), W("WITH " + _CLS.rstrip(", ") + " SELECT repo_id, run_id, classified AS status, CASE WHEN stderr = '' THEN 'Unknown error (no stderr)' ELSE stderr END AS message FROM cl WHERE classified NOT IN ('SUCCESS', 'PARTIAL_SUCCESS')", "users")),
    Query("c4_c5_category_histogram", lambda c: run_table(c).withColumn("category", C.category(None)).groupBy("category").agg(F.count(F.lit(1)).alias("runs")), W("WITH " + _CAT.rstrip(", ") + " SELECT category, count(*) AS runs FROM ca GROUP BY 1", "users")),
    Query("c8_quality_gate", lambda c: r6(C.gate(run_table(c).withColumn("category", C.category(None)))), W(
        "WITH " + _CAT.rstrip(", ") + " SELECT *, instrumentation_rate <= 0.2 AND model_rate <= 0.15 AS passed FROM (SELECT count(*) AS runs, round(count(*) FILTER (category = 'INSTRUMENTATION_FAILURE') / count(*), 6) AS instrumentation_rate, round(count(*) FILTER (category = 'MODEL_FAILURE') / count(*), 6) AS model_rate FROM ca)", "users")),
    Query("c11_error_messages", lambda c: c.table("documents").select("doc_id", C.error_message(F.col("text")).alias("message"))),
]
