"""Run and repository roll-ups of an event stream.

Maps of unbounded key sets (agents, tools, error types) are kept as tall tables keyed by
(repo_id, run_id, name): they aggregate map-side and never gather one run into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spoor.constants import AGENT_END, AGENT_START, DELEGATIONS, RUN_ERRORS
from spoor.functions.ordered import scan
from spoor.functions.stats import count_if, ratio
from spoor.functions.text import nz

RUN = ["repo_id", "run_id"]


def ref_name(ref: str, default: str) -> Column:
    """Display name of a node reference, else its id, else a default."""
    return F.coalesce(nz(F.col(f"{ref}.node_name")), nz(F.col(f"{ref}.node_id")), F.lit(default))


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(*RUN, "event_type").agg(F.count(F.lit(1)).alias("events"))


def timeline(events: DataFrame) -> DataFrame:
    t = events.groupBy(*RUN).agg(F.min("timestamp_ns").alias("start_ns"), F.max("timestamp_ns").alias("end_ns"))
    return t.withColumn("duration_ns", F.col("end_ns") - F.col("start_ns")).withColumn("duration_ms", F.col("duration_ns") / 1e6)


def agent_activations(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    start, end, err = et.isin(AGENT_START), et.isin(AGENT_END), et.isin(RUN_ERRORS)
    return (
        events.filter(start | end | err)
        .groupBy(*RUN, ref_name("source_node", "unknown_agent").alias("agent"))
        .agg(count_if(start).alias("start_events"), count_if(end).alias("end_events"), count_if(err).alias("error_events"))
        .withColumn("activation_count", F.col("start_events"))
    )


def tool_invocations(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    ok = F.coalesce(F.col("payload.status"), F.lit("success")) == "success"
    return (
        events.filter(et.isin("tool.invoked", "tool.completed", "tool.call_failure"))
        .groupBy(*RUN, F.coalesce(nz(F.col("payload.tool_name")), F.lit("unknown_tool")).alias("tool"))
        .agg(
            count_if(et == "tool.invoked").alias("invocation_count"),
            count_if((et == "tool.completed") & ok).alias("success_count"),
            count_if(((et == "tool.completed") & ~ok) | (et == "tool.call_failure")).alias("failure_count"),
        )
    )


def paired(events: DataFrame, starts: list[str], ends: list[str], *, ends_cols: list[str] = ()) -> DataFrame:
    """End events with the start their parent id names, in the same run and not later than the end."""
    s = events.filter(F.col("event_type").isin(starts)).select(*RUN, F.col("event_id").alias("parent_event_id"), F.col("timestamp_ns").alias("start_ns"))
    e = events.filter(F.col("event_type").isin(ends) & F.col("parent_event_id").isNotNull())
    e = e.select(*RUN, "event_id", "parent_event_id", F.col("timestamp_ns").alias("end_ns"), *ends_cols)
    return e.join(s, [*RUN, "parent_event_id"]).filter("start_ns <= end_ns").withColumn("latency_ns", F.col("end_ns") - F.col("start_ns"))


def llm_calls(events: DataFrame) -> DataFrame:
    et, p = F.col("event_type"), "payload."
    tokens = F.coalesce(F.col(p + "input_tokens"), F.lit(0)) + F.coalesce(F.col(p + "output_tokens"), F.lit(0))
    calls = (
        events.filter(et.isin("llm.call_start", "llm.call_end")).groupBy(*RUN)
        .agg(count_if(et == "llm.call_start").alias("llm_calls"), F.coalesce(F.sum(F.when(et == "llm.call_end", tokens)), F.lit(0)).alias("total_tokens"))
    )
    lat = (
        paired(events, ["llm.call_start"], ["llm.call_end"]).groupBy(*RUN)
        .agg(F.sum("latency_ns").alias("latency_sum_ns"), F.count(F.lit(1)).alias("latency_count"))
    )
    out = calls.join(lat, RUN, "left").fillna(0, ["latency_sum_ns", "latency_count"])
    return out.withColumn("avg_latency_ms", ratio(F.col("latency_sum_ns"), F.col("latency_count")) / 1e6)


def error_types(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("event_type").isin(RUN_ERRORS))
        .groupBy(*RUN, F.coalesce(nz(F.col("payload.error_type")), F.col("event_type")).alias("error_type"))
        .agg(F.count(F.lit(1)).alias("errors"), F.greatest(F.max(F.coalesce("stack_depth", F.lit(0))), F.lit(0)).alias("max_depth"))
    )


def delegation_chain(events: DataFrame) -> DataFrame:
    """Delegations of each run with their position in time order, one row per delegation."""
    d = events.filter(F.col("event_type").isin(DELEGATIONS)).select(
        *RUN, "event_id", "timestamp_ns", "event_type",
        ref_name("source_node", "unknown").alias("delegator"), ref_name("target_node", "unknown").alias("delegate"),
    )
    return scan(d, RUN, "timestamp_ns", {"position": ("sum", F.lit(1))}, tie=["event_id"])


def run_records(events: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row per run. With a run table, runs without events come out with zeros."""
    et = F.col("event_type")
    err = et.isin(RUN_ERRORS)
    rec = (
        events.groupBy(*RUN)
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            F.min("timestamp_ns").alias("start_ns"), F.max("timestamp_ns").alias("end_ns"),
            count_if(err).alias("total_errors"),
            F.coalesce(F.greatest(F.max(F.when(err, F.coalesce("stack_depth", F.lit(0)))), F.lit(0)), F.lit(0)).alias("max_propagation_depth"),
            count_if(et.isin(DELEGATIONS)).alias("delegations"),
            count_if(et == "state.access").alias("state_access_count"),
            count_if(et == "routing.decision").alias("routing_decision_count"),
        )
        .withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))
        .withColumn("duration_ms", F.col("duration_ns") / 1e6)
    )
    rec = rec.join(llm_calls(events), RUN, "left")
    if runs is not None:
        rec = runs.select(*RUN).distinct().join(rec, RUN, "left")
    return rec.fillna(0)


def repo_summaries(records: DataFrame) -> DataFrame:
    """Second aggregation step: run records to one row per repository."""
    moved = F.when(F.col("duration_ns") > 0, F.col("duration_ns"))
    ms = lambda ns: F.coalesce(ns / 1e6, F.lit(0.0))
    return records.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("num_runs"), F.sum("total_events").alias("total_events"),
        (F.sum("total_events") / F.count(F.lit(1))).alias("avg_events_per_run"),
        ms(F.min(moved)).alias("min_duration_ms"), ms(F.max(moved)).alias("max_duration_ms"), ms(F.avg(moved)).alias("avg_duration_ms"),
        F.sum("llm_calls").alias("llm_calls"), F.sum("total_tokens").alias("total_tokens"),
        (ratio(F.sum("latency_sum_ns"), F.sum("latency_count")) / 1e6).alias("avg_latency_ms"),
        F.sum("total_errors").alias("total_errors"), F.max("max_propagation_depth").alias("max_propagation_depth"),
        count_if(F.col("total_errors") > 0).alias("runs_with_errors"),
    )


def roll_tall(tall: DataFrame, name: str) -> DataFrame:
    """Sum a per-run tall table (agents, tools, error types) to the repository."""
    counts = [c for c in tall.columns if c not in (*RUN, name, "max_depth")]
    return tall.groupBy("repo_id", name).agg(*[F.sum(c).alias(c) for c in counts])


def nodes_seen(events: DataFrame) -> DataFrame:
    """Distinct node ids of a repository's events, from either end."""
    ids = events.select("repo_id", F.explode(F.array("source_node.node_id", "target_node.node_id")).alias("node_id"))
    return ids.filter(nz(F.col("node_id")).isNotNull()).distinct()


def execution_metadata(runs: DataFrame) -> DataFrame:
    """runs(repo_id, run_id, framework, status, events, duration_ms): counts, success share, frameworks."""
    return runs.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("num_runs"), F.sum("events").alias("total_events"),
        (count_if(F.col("status").isin("SUCCESS", "PARTIAL_SUCCESS", "TIER2_SUCCESS", "TIER2_PARTIAL")) / F.count(F.lit(1))).alias("success_rate"),
        F.avg("duration_ms").alias("mean_duration_ms"),
        F.array_join(F.sort_array(F.collect_set("framework")), ",").alias("frameworks"),
    )


def collection_stats(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("runs"), F.count_distinct("repo_id").alias("repos"),
        F.sum("total_events").alias("events"), F.sum("total_errors").alias("errors"),
    )


# ---- denormalised repository documents ------------------------------------------
def agent_tasks(events: DataFrame) -> DataFrame:
    """Tasks of each agent: a start, closed by the next end of the same agent before its next start."""
    et = F.col("event_type")
    name = F.coalesce(nz(F.col("payload.agent_role")), nz(F.col("source_node.node_name")))
    e = events.filter(et.isin("agent.task_start", "agent.task_end")).select(
        *RUN, "event_id", "timestamp_ns", F.coalesce(nz(F.col("source_node.node_id")), name, F.lit("agent")).alias("agent_key"), name.alias("agent_name"), (et == "agent.task_start").alias("is_start"),
        F.when(et == "agent.task_end", F.struct(F.coalesce("payload.status", F.lit("success")).alias("status"), F.coalesce("payload.output_preview", F.lit("")).alias("output_text"), F.col("payload.output_hash").alias("output_hash"))).alias("end"),
        F.col("payload.input_source").alias("input_source"))
    keys = [*RUN, "agent_key"]
    # the last end before the next start closes a task: a start is barred by the start after it
    nxt = scan(e, keys, "timestamp_ns", {"next_start": ("nearest", F.when(F.col("is_start"), F.col("timestamp_ns")))}, tie=["event_id"], direction="after")
    cur = scan(nxt, keys, "timestamp_ns", {"task_id": ("nearest", F.when(F.col("is_start"), F.col("event_id")))}, tie=["event_id"], inclusive=True)
    ends = cur.filter("NOT is_start AND task_id IS NOT NULL").groupBy(*keys, "task_id").agg(F.max_by("end", F.struct("timestamp_ns", "event_id")).alias("end"))
    starts = cur.filter("is_start").select(*keys, F.col("event_id").alias("task_id"), "timestamp_ns", "agent_name", "input_source")
    return starts.join(ends, [*keys, "task_id"], "left").select(*keys, "task_id", "timestamp_ns", "agent_name", "input_source",
                                                             F.coalesce("end.status", F.lit("")).alias("status"), F.coalesce("end.output_text", F.lit("")).alias("output_text"), "end.output_hash")


def llm_attribution(events: DataFrame) -> DataFrame:
    """Completed model calls with the agent they belong to: the node stack first, else the open agent."""
    et = F.col("event_type")
    nid, name = nz(F.col("source_node.node_id")), F.coalesce(nz(F.col("payload.agent_role")), nz(F.col("source_node.node_name")))
    e = events.filter(et.isin("agent.task_start", "agent.task_end", "llm.call_end"))
    e = e.withColumn("_open", F.when(et == "agent.task_start", F.coalesce(nid, name, F.lit("agent"))).when(et == "agent.task_end", F.lit("")))
    e = scan(e, RUN, "timestamp_ns", {"open_agent": ("nearest", F.col("_open"))}, tie=["event_id"]).filter("event_type = 'llm.call_end'")
    known = events.filter((et == "agent.task_start") & nid.isNotNull()).groupBy(*RUN, nid.alias("node_id")).agg(F.min("timestamp_ns").alias("since"))
    stack = e.select(*RUN, "event_id", "timestamp_ns", F.posexplode("payload.active_node_stack").alias("pos", "node_id")).join(known, [*RUN, "node_id"]).filter("since <= timestamp_ns")
    top = stack.groupBy(*RUN, "event_id").agg(F.min_by("node_id", "pos").alias("stack_agent"))
    return e.join(top, [*RUN, "event_id"], "left").select(*RUN, "event_id", F.coalesce("stack_agent", nz(F.col("open_agent")), F.lit("")).alias("agent_key"),
                                                      F.coalesce("payload.input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("payload.output_tokens", F.lit(0)).alias("output_tokens"))


def first_wins(docs: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the document of the earliest source for each key."""
    first = docs.groupBy(key).agg(F.min(order).alias(order))
    return docs.join(first, [key, order], "left_semi")


def repo_full_name(url: Column) -> Column:
    parts = F.split(F.regexp_replace(url, "/+$", ""), "/")
    return F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.element_at(parts, -1))


# ---- corpus reports ----------------------------------------------------------------
def score_distribution(scores: DataFrame, names: list[str]) -> DataFrame:
    """scores(repo_id, <names>): mean, upper median, min, max, sample sd and n of each score."""
    from spoor.functions.ordered import element_at_rank

    long = scores.select(F.expr(f"stack({len(names)}, {', '.join(f'{n!r}, CAST({n} AS DOUBLE)' for n in names)}) AS (score, value)")).filter("value IS NOT NULL")
    med = element_at_rank(long, ["score"], "value", F.floor(F.col("_total") / 2), "median")
    agg = long.groupBy("score").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n"))
    return agg.join(med, "score")


def prevalence(modes: DataFrame, by: str = "finding_id", manifested: str = "manifestation_observed") -> DataFrame:
    """Repositories that show each mode over repositories that list it."""
    per = modes.groupBy("repo_id", by).agg(F.max(manifested).alias("m"))
    return per.groupBy(by).agg(F.count(F.lit(1)).alias("repos_seen"), count_if(F.col("m")).alias("repos_manifested")).withColumn("prevalence", F.col("repos_manifested") / F.col("repos_seen"))


def multi_run_stats(events: DataFrame) -> DataFrame:
    """Repositories with a first run, repositories with more runs, runs in total."""
    per = events.select(*RUN).distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("runs"))
    return per.agg(F.count(F.lit(1)).alias("repos"), count_if(F.col("runs") > 1).alias("repos_multi_run"), F.sum("runs").alias("runs_total"))


def topology_by_tier(topology: DataFrame, tiers: DataFrame) -> DataFrame:
    """topology(repo_id, topology) x tiers(repo_id, tier): counts with one column per tier."""
    j = topology.join(tiers.select("repo_id", F.coalesce("tier", F.lit(1)).alias("tier")), "repo_id")
    return j.groupBy("topology").agg(count_if(F.col("tier") == 1).alias("tier_1"), count_if(F.col("tier") == 2).alias("tier_2"), F.count(F.lit(1)).alias("total"))
