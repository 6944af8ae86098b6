"""Validation and audits of events, runs and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spoor.functions.stats import bool_or, count_if, ratio
from spoor.functions.text import nz

RUN = ["repo_id", "run_id"]
# fixed values: event types that feed each section of a behavioral record
EDGE_SECTION = ["edge.traversed", "delegation.initiated", "delegation.completed", "tool.invoked", "tool.completed"]
NODE_SECTION = ["agent.task_start", "agent.task_end", "llm.call_start", "llm.call_end", "tool.invoked", "tool.completed"]
DIVERSITY_SECTION = ["agent.task_start", "agent.task_end", "llm.call_start", "llm.call_end", "delegation.initiated",
                     "delegation.completed", "tool.invoked", "tool.completed", "state.access", "routing.decision"]
KNOWN_TYPES = [
    "agent.task_start", "agent.task_end", "llm.call_start", "llm.call_end", "tool.invoked", "tool.completed", "tool.call_failure",
    "delegation.initiated", "delegation.completed", "state.access", "routing.decision", "error.occurred", "error.propagated", "error.cascade",
    "execution.start", "execution.end", "edge.traversed", "message.received", "reply.generated", "data.read", "data.write", "external.call", "guardrail.triggered",
]
LIFECYCLE = ["execution.start", "execution.end", "error.occurred", "error.propagated"]
GENERIC_NAME = r"(_runner|^unhandled_exception)$"  # names of the harness itself, not of agents


def compare_ids(structural: DataFrame, behavioral: DataFrame) -> DataFrame:
    """Set comparison of structural and behavioral node ids per repository, from one outer join."""
    a = structural.select("repo_id", "node_id").distinct().withColumn("s", F.lit(True))
    b = behavioral.select("repo_id", "node_id").distinct().withColumn("b", F.lit(True))
    j = a.join(b, ["repo_id", "node_id"], "full_outer").groupBy("repo_id").agg(
        count_if(F.col("s") & F.col("b")).alias("matched"), count_if(F.col("b").isNull()).alias("structural_only"), count_if(F.col("s").isNull()).alias("behavioral_only"))
    rate = F.col("matched") / (F.col("matched") + F.col("structural_only") + F.col("behavioral_only"))
    return j.withColumn("match_rate", rate).withColumn("compatible", (rate >= 0.5) & (F.col("behavioral_only") == 0))


def behavioral_class(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    agg = events.groupBy(*RUN).agg(bool_or(et.startswith("agent.")).alias("a"), bool_or(et.startswith("llm.")).alias("l"))
    return agg.select(*RUN, F.when(F.col("a") & F.col("l"), "FULL_BEHAVIORAL").when(F.col("l"), "LLM_ONLY").otherwise("NO_BEHAVIORAL_DATA").alias("behavioral_class"))


def file_counters(parsed: DataFrame, key: list[str]) -> DataFrame:
    """Per file: lines, corrupt lines, doubled model prefixes, calls and captured previews."""
    et, p = F.col("event_type"), F.col("payload")
    ok = ~F.col("corrupt")
    return parsed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("event_count"), count_if(F.col("corrupt")).alias("corrupt_lines"), count_if(ok & F.col("line").contains("openai/openai/")).alias("double_prefix"),
        count_if(ok & (et == "llm.call_start")).alias("llm_starts"), count_if(ok & (et == "llm.call_end")).alias("llm_ends"), count_if(ok & et.startswith("agent.")).alias("agent_events"),
        count_if(ok & (et == "llm.call_start") & nz(p["last_user_message_preview"]).isNotNull()).alias("has_user_message"), count_if(ok & (et == "llm.call_end") & nz(p["output_preview"]).isNotNull()).alias("has_output"))


def corpus_quality(runs: DataFrame, classes: DataFrame) -> DataFrame:
    """One-row audit. runs(repo_id, scan_id, has_events, has_metadata, double_prefix) one row per repository."""
    beh = classes.groupBy("repo_id").agg(bool_or(F.col("behavioral_class") != "NO_BEHAVIORAL_DATA").alias("behavioral"))
    a = runs.join(beh, "repo_id", "left").agg(
        F.count(F.lit(1)).alias("repos_total"), count_if(F.col("has_events")).alias("repos_with_events"), count_if(F.col("has_metadata")).alias("repos_with_metadata"),
        count_if(F.col("behavioral")).alias("behavioral_repos"), F.sum("double_prefix").alias("double_prefix"), F.count_distinct("scan_id").alias("scan_ids"))
    share = lambda c, w: ratio(F.col(c), F.col("repos_total")) * w
    score = share("repos_with_events", 30) + share("repos_with_metadata", 20) + share("behavioral_repos", 30) + F.when(F.col("double_prefix") == 0, 10).otherwise(0) + F.when(F.col("scan_ids") == 1, 10).otherwise(0)
    return a.withColumn("data_quality_score", score)


def record_compatibility(events: DataFrame) -> DataFrame:
    """YES / PARTIAL / NO: which record sections a repository's event types can fill."""
    types = events.select("repo_id", "event_type").distinct()
    et = F.col("event_type")
    a = types.groupBy("repo_id").agg(bool_or(et.isin(EDGE_SECTION)).alias("edge_validation"), bool_or(et.isin(NODE_SECTION)).alias("node_activation"), (count_if(et.isin(DIVERSITY_SECTION)) >= 3).alias("behavioral_diversity"))
    n = F.col("edge_validation").cast("int") + F.col("node_activation").cast("int") + F.col("behavioral_diversity").cast("int")
    return a.withColumn("compatible", F.when(n == 3, "YES").when(n == 0, "NO").otherwise("PARTIAL"))


def run_files(events: DataFrame) -> DataFrame:
    per = events.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("repo_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("events"), F.min("n").alias("smallest_run"), F.max("n").alias("largest_run")).withColumn("enough_for_activation_rate", F.col("runs") >= 3)


def duplicate_events(events: DataFrame) -> DataFrame:
    return events.groupBy("repo_id", "event_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def trace_audit(events: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """Per repository: missing fields, unknown types, duplicates and reported-count mismatch."""
    missing = F.lit(0)
    for f in ("event_id", "timestamp_ns", "run_id", "repo_id", "framework", "event_type"):
        missing = missing + F.col(f).isNull().cast("int")
    a = events.groupBy("repo_id").agg(F.count(F.lit(1)).alias("events"), F.sum(missing).alias("missing_fields"), count_if(~F.col("event_type").isin(KNOWN_TYPES)).alias("unknown_types"))
    d = duplicate_events(events).groupBy("repo_id").agg(F.count(F.lit(1)).alias("duplicate_ids"))
    out = a.join(d, "repo_id", "left").fillna(0)
    if reported is not None:
        out = out.join(reported.select("repo_id", "reported_events"), "repo_id", "left").withColumn("count_mismatch", F.col("reported_events") != F.col("events"))
    return out


def content_flows(events: DataFrame) -> DataFrame:
    """Task starts whose input source produced a hashed output in the same run."""
    ends = events.filter((F.col("event_type") == "agent.task_end") & nz(F.col("payload.output_hash")).isNotNull()).select(*RUN, F.col("source_node.node_id").alias("producer")).filter("producer <> ''").distinct()
    starts = events.filter((F.col("event_type") == "agent.task_start") & nz(F.col("payload.input_source")).isNotNull()).select(*RUN, F.col("payload.input_source").alias("producer"), F.col("source_node.node_id").alias("consumer")).filter("consumer <> ''").distinct()
    return starts.join(ends, [*RUN, "producer"], "left_semi")


def trace_profile(events: DataFrame) -> DataFrame:
    """Distinct nodes and agents, captured inputs and outputs, topology events."""
    p, et, name = lambda n: F.col(f"payload.{n}"), F.col("event_type"), F.col("source_node.node_name")
    flags = events.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_events"), bool_or(nz(p("agent_goal")).isNotNull()).alias("sp"), bool_or(nz(p("last_user_message_preview")).isNotNull()).alias("um"),
        bool_or(nz(p("output_preview")).isNotNull()).alias("has_output"), bool_or((p("input_tokens") > 0) | (p("output_tokens") > 0)).alias("has_tokens"),
        bool_or(et.isin("edge.traversed", "routing.decision")).alias("has_edge_events"), bool_or(et.isin("delegation.initiated", "delegation.completed")).alias("has_delegation_events"))
    ids = events.filter(nz(F.col("source_node.node_id")).isNotNull()).select("repo_id", "source_node.node_id").distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("unique_source_nodes"))
    agents = events.filter(nz(name).isNotNull() & ~name.rlike(GENERIC_NAME)).select("repo_id", name.alias("n")).distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("unique_agents"))
    out = flags.join(ids, "repo_id", "left").join(agents, "repo_id", "left").fillna(0)
    io = (F.col("sp").cast("int") + F.col("um").cast("int") + F.col("has_output").cast("int") + F.col("has_tokens").cast("int")) / 4
    return out.withColumn("io_completeness", io).drop("sp", "um")


def first_payloads(events: DataFrame) -> DataFrame:
    """The first payload of each event type and repository."""
    return events.groupBy("repo_id", "event_type").agg(F.min_by(F.struct("event_id", F.to_json("payload").alias("payload")), F.struct("timestamp_ns", "event_id")).alias("f")).select("repo_id", "event_type", "f.event_id", "f.payload")


def coverage(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Field coverage per row: a field counts when neither null nor empty; ready flags per group."""
    types = dict(df.dtypes)

    def present(c: str) -> Column:
        t = types[c]
        if t.startswith(("array", "map")):
            return F.coalesce(F.size(c) > 0, F.lit(False))
        return F.coalesce(nz(F.col(c)).isNotNull(), F.lit(False)) if t == "string" else F.col(c).isNotNull()

    fields = [c for cols in groups.values() for c in cols]
    n = sum((present(c).cast("int") for c in fields), F.lit(0))
    out = df.withColumn("coverage_pct", n / len(fields) * 100)
    for g, cols in groups.items():
        ready = F.lit(True)
        for c in cols:
            ready = ready & present(c)
        out = out.withColumn(f"{g}_ready", ready)
    return out


def grade_trace(events: DataFrame) -> DataFrame:
    """RICH / BASIC / EMPTY per run: agents, hashed outputs and content flow, else any completed call."""
    et, p = F.col("event_type"), lambda n: F.col(f"payload.{n}")
    agents = events.filter((F.col("source_node.node_type") == "agent") & nz(F.col("source_node.node_id")).isNotNull()).select(*RUN, "source_node.node_id").distinct().groupBy(*RUN).agg(F.count(F.lit(1)).alias("agents"))
    a = events.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n"), bool_or((et == "agent.task_end") & nz(p("output_hash")).isNotNull()).alias("h"), bool_or((et == "agent.task_start") & nz(p("input_source")).isNotNull()).alias("f"),
        bool_or(et == "llm.call_end").alias("l"), bool_or(~et.isin("execution.start", "execution.end")).alias("more"))
    a = a.join(agents, RUN, "left").fillna(0, ["agents"])
    g = F.when((F.col("agents") >= 2) & F.col("h") & F.col("f"), "RICH").when(F.col("l"), "BASIC").when(~F.col("more"), "EMPTY").when(F.col("n") >= 3, "BASIC").otherwise("EMPTY")
    return a.select(*RUN, g.alias("grade"))


def grade_repo(events: DataFrame) -> DataFrame:
    """RICH / BASIC / THIN / EMPTY per repository (the stricter, four-level grade)."""
    et, p = F.col("event_type"), lambda n: F.col(f"payload.{n}")
    agents = events.filter((F.col("source_node.node_type") == "agent") & nz(F.col("source_node.node_id")).isNotNull()).select("repo_id", "source_node.node_id").distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("agents"))
    a = events.groupBy("repo_id").agg(
        bool_or((et == "agent.task_end") & nz(p("output_hash")).isNotNull()).alias("h"), bool_or((et == "agent.task_start") & F.coalesce(nz(p("parent_node_id")), nz(p("input_source"))).isNotNull()).alias("f"),
        bool_or(et.isin("delegation.initiated", "tool.invoked", "state.access", "routing.decision")).alias("rich"), count_if(et == "llm.call_end").alias("l"), bool_or(et.isin("agent.task_start", "agent.task_end")).alias("life"), bool_or(~et.isin(LIFECYCLE)).alias("more"))
    a = a.join(agents, "repo_id", "left").fillna(0, ["agents"])
    g = F.when((F.col("agents") >= 2) & F.col("h") & F.col("f") & F.col("rich"), "RICH").when((F.col("l") > 0) & F.col("life"), "BASIC").when(F.col("l") > 0, "THIN").when(~F.col("more"), "EMPTY").otherwise("THIN")
    return a.select("repo_id", g.alias("grade"))


def graph_topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """with_delegation / single_agent / hub_and_spoke / sequential_N_agent per repository."""
    agents = nodes.filter(F.col("node_type").isin("agent", "orchestrator")).select("repo_id", "node_id").distinct()
    n = agents.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    out = edges.join(agents.withColumnRenamed("node_id", "source"), ["repo_id", "source"], "left_semi").groupBy("repo_id", "source").agg(F.count(F.lit(1)).alias("d")).groupBy("repo_id").agg(F.max("d").alias("fan"))
    dl = edges.groupBy("repo_id").agg(bool_or(F.col("edge_type") == "delegates_to").alias("dl"))
    j = n.join(out, "repo_id", "left").join(dl, "repo_id", "left")
    return j.select("repo_id", F.when(F.col("dl"), "with_delegation").when(F.col("n") == 1, "single_agent").when(F.col("fan") > 2, "hub_and_spoke").otherwise(F.format_string("sequential_%d_agent", "n")).alias("topology"))
