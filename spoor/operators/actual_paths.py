"""Where errors really went: the script variant of the error traces.

A node is on an error's path if it errs later in the run, at its first error after the seed. So an error
of a node is on the path of exactly the seeds between the node's error before it and itself: an interval
of positions. Paths come from points in intervals, never from a join of seeds with all later errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from spoor.functions.intervals import stab
from spoor.functions.ordered import scan
from spoor.functions.text import nz
from spoor.operators.propagation import RUN, SEED, first_seed_per_node, swallow_flags
from spoor.session import land
from spoor.sources.inline import values

# fixed values: finding -> (name, failure type, signals)
SCRIPT_FINDINGS = {
    "STRAT-DC-001": ("Unsupervised delegation chain", "Cascading errors through unsupervised delegation chain", ["no_human_gate_activation", "delegation_depth"]),
    "STRAT-SI-001": ("Error laundering", "Error silently swallowed, downstream agents process corrupted data", ["silent_error_handling", "error_swallowed"]),
    "STRAT-AB-001": ("Autonomous behavior drift", "Agent behavior drifts from intended scope without detection", ["output_divergence", "unexpected_tool_usage"]),
    "STRAT-OC-002": ("Concurrent state conflict", "Multiple agents write to shared state without coordination", ["concurrent_state_writes", "state_overwrite"]),
    "STRAT-EA-001": ("External API dependency failure", "Agent fails due to external tool/API unavailability", ["tool_call_failure", "api_timeout"]),
}


def erring(events: DataFrame) -> DataFrame:
    """Errors and failed ends with their node, their place among the run's (from 1), and the place of the node's one before (0: none)."""
    et, st = F.col("event_type"), F.col("payload.status")
    node = F.coalesce(nz(F.col("source_node.node_id")), nz(F.col("payload.node_id")))
    bad = et.isin("error.occurred", "error.propagated") | (et.isin("agent.task_end", "tool.completed") & st.isin("failed", "error"))
    e = scan(events.filter(bad).select(*SEED, "timestamp_ns", node.alias("node")), RUN, "timestamp_ns", {"place": ("sum", F.lit(1))}, tie=["event_id"], inclusive=True)
    e = land(e, "erring")
    named = scan(e.filter("node IS NOT NULL"), [*RUN, "node"], "timestamp_ns", {"before": ("nearest", F.col("place"))}, tie=["event_id"])
    return named.withColumn("before", F.coalesce("before", F.lit(0))).unionByName(e.filter("node IS NULL").withColumn("before", F.lit(None).cast("long")))


def path_steps(events: DataFrame) -> DataFrame:
    """(repo_id, run_id, event_id, step, node): the nodes an error reached in the order of their first error after it.

    One seed is the first error of a node in a run, and every error without a node; step 0 is the seed's own node.
    """
    e = land(erring(events), "erring_before")
    seeds = first_seed_per_node(events).select(*SEED, F.col("node").alias("source")).join(e.select(*SEED, F.col("place").alias("at")), SEED)
    later = e.filter("node IS NOT NULL").select(*RUN, "node", "before", "place")
    hit = stab(later, seeds, RUN, "before", "place", "at").filter("source IS NULL OR node <> source")
    order = W.partitionBy(*SEED).orderBy("place")  # at most one row a node of the run
    reached = hit.withColumn("step", F.row_number().over(order)).select(*SEED, "step", "node")
    own = seeds.filter("source IS NOT NULL").select(*SEED, F.lit(0).alias("step"), F.col("source").alias("node"))
    return own.unionByName(reached)


def actual_traces(events: DataFrame) -> DataFrame:
    """Per seed: source, actual_path, last_node, stop_mechanism, later_errors, later_failed, swallowed.

    stop_mechanism is no_propagation for an empty path; else it looks at the last node's events after the seed:
    retry_succeeded if one is a successful task end (for a node named guard or review only if it is the first),
    error_boundary if a node named guard or review did anything else first, end_of_chain otherwise.
    """
    steps = path_steps(events)
    paths = steps.groupBy(*SEED).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda s: s["node"]).alias("actual_path"))
    seeds = first_seed_per_node(events).select(*SEED, "timestamp_ns", F.col("node").alias("source"))
    t = seeds.join(paths, SEED, "left").withColumn("actual_path", F.coalesce("actual_path", F.array().cast("array<string>")))
    t = land(t.withColumn("last_node", F.try_element_at("actual_path", F.lit(-1))), "actual_paths")

    node = F.col("source_node.node_id")
    gate = F.lower(node).contains("guard") | F.lower(node).contains("review")
    ok = (F.col("event_type") == "agent.task_end") & (F.col("payload.status") == "success")
    told = events.filter(nz(node).isNotNull() & (gate | F.coalesce(ok, F.lit(False)))).select(*RUN, node.alias("node"), "timestamp_ns", F.col("event_id").alias("tie"), F.lit(None).cast("string").alias("event_id"), F.coalesce(ok, F.lit(False)).alias("success"))
    ask = t.filter("last_node IS NOT NULL").select(*RUN, F.col("last_node").alias("node"), "timestamp_ns", F.concat("event_id", F.lit("~")).alias("tie"), "event_id", F.lit(None).cast("boolean").alias("success"))
    met = scan(told.unionByName(ask), [*RUN, "node"], "timestamp_ns", {"first_is_success": ("nearest", F.col("success")), "successes": ("sum", F.col("success").cast("int"))}, tie=["tie"], direction="after")
    met = met.filter("event_id IS NOT NULL").select(*SEED, "first_is_success", "successes")
    t = t.join(met, SEED, "left").join(swallow_flags(events).select(*SEED, "later_errors", "later_failed", "swallowed"), SEED, "left")
    gated = F.lower("last_node").contains("guard") | F.lower("last_node").contains("review")
    how = F.when(F.col("last_node").isNull(), "no_propagation").when(gated & (F.col("first_is_success") == F.lit(False)), "error_boundary").when(F.coalesce("successes", F.lit(0)) > 0, "retry_succeeded").otherwise("end_of_chain")
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return t.select(*SEED, "source", "actual_path", "last_node", how.alias("stop_mechanism"), none("later_errors", 0), none("later_failed", 0), none("swallowed", False))


def script_failure_modes(signals: DataFrame) -> DataFrame:
    """The five findings per repository from `failure.run_signals`: occurrences over their signals, impact and description."""
    s = signals.withColumn("silent_error_handling", F.col("error_swallowed"))
    parts = [(f, n, t, i, name) for f, (n, t, names) in SCRIPT_FINDINGS.items() for i, name in enumerate(names)]
    names = [p[4] for p in parts]
    tall = s.select("repo_id", F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).cast("long").alias("n")) for n in names])).alias("x")).select("repo_id", "x.*")
    spec = values(signals.sparkSession, parts, ["finding_id", "finding_name", "failure_type", "ord", "signal"])
    seen = F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("ord", "signal", "n"))), lambda x: F.when(x["n"] > 0, x["signal"])))
    out = tall.join(F.broadcast(spec), "signal").groupBy("repo_id", "finding_id", "finding_name", "failure_type").agg(F.sum("n").alias("occurrences"), seen.alias("seen"))  # spec: ten fixed rows
    hit = F.col("occurrences") > 0
    text = F.when(hit, F.concat(F.lit("Seen "), F.col("occurrences").cast("string"), F.lit(" times: "), F.array_join("seen", ", ")))
    return out.select("repo_id", "finding_id", "finding_name", "failure_type", hit.alias("manifestation_observed"), "occurrences", hit.alias("downstream_impact"), text.alias("failure_description"))


# ---- traces of any shape ---------------------------------------------------------------
# fixed values: canonical field -> names it goes by, first found wins
TRACE_NAMES = {
    "error_source_node": ["error_source_node", "origin_node"], "error_type": ["error_type", "origin_error_type"], "propagation_stopped_by": ["propagation_stopped_by"], "stop_mechanism": ["stop_mechanism", "error_handling_observed"], "run_id": ["run_id"],
}
PATH_NAMES = {"structural_predicted_path": ["structural_predicted_path", "propagation_path"], "actual_observed_path": ["actual_observed_path", "propagation_path"]}
IMPACT = ["nodes_affected", "downstream_errors", "downstream_tasks_failed", "cascade_depth"]


def normalized_traces(traces: DataFrame) -> DataFrame:
    """Canonical columns of error traces(key columns, t), t a variant object of either naming.

    A field takes the first of its names that is there, even if it does not fit its kind (then it is '' or an empty list).
    The impact is an object with counters (missing ones 0), or a flag that stands for one node, one error and one step.
    """
    from spoor.sources.scans import field

    there = lambda n: field(n, "variant", doc="t")

    def first(names: list[str], kind: str, default):
        out = default
        for n in reversed(names):
            out = F.when(there(n).isNotNull(), F.coalesce(field(n, kind, doc="t"), default)).otherwise(out)
        return out

    empty = F.array().cast("array<string>")
    kind = F.schema_of_variant(there("downstream_impact"))
    flag = F.coalesce((kind == "BOOLEAN") & field("downstream_impact", "boolean", doc="t"), F.lit(False))
    counted = kind.startswith("OBJECT")
    impact = [F.when(F.coalesce(counted, F.lit(False)), F.coalesce(field(f"downstream_impact.{k}", "long", doc="t"), F.lit(0))).otherwise(F.lit(0) if k == "downstream_tasks_failed" else flag.cast("long")).alias(k) for k in IMPACT]
    keys = [c for c in traces.columns if c != "t"]
    return traces.select(
        *keys, *[first(names, "string", F.lit("")).alias(c) for c, names in TRACE_NAMES.items()], *[first(names, "array<string>", empty).alias(c) for c, names in PATH_NAMES.items()], *impact,
        F.coalesce(field("structural_prediction_match", "boolean", doc="t"), F.lit(False)).alias("structural_prediction_match"))
