"""Error traces: what each error was predicted to reach, what it reached, and what stopped it.

"Later in the run" is never a join of error events with all later events. Per (run, node) the
last and next occurrence decide membership, through aggregates and nearest-following scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spoor.functions.ordered import scan
from spoor.functions.stats import ratio
from spoor.functions.text import nz
from spoor.operators.resolve import lookup_keys, name_to_id
from spoor.session import cut

RUN = ["repo_id", "run_id"]
SEED = [*RUN, "event_id"]


def _where(*, with_error_id: bool = False) -> Column:
    """The node an event speaks of: payload node first, then the source's id or name."""
    first = [nz(F.col("payload.error_node_id"))] if with_error_id else []
    return F.coalesce(*first, nz(F.col("payload.node_id")), nz(F.col("source_node.node_id")), nz(F.col("source_node.node_name")))


def _resolve(df: DataFrame, ref: str, names: DataFrame, out: str) -> DataFrame:
    """Structural id of a reference: itself by id or name, else the class part of a runtime id."""
    keys = df.select("repo_id", ref).distinct().select("repo_id", ref, F.posexplode(lookup_keys(F.col(ref))).alias("_p", "_k"))
    hit = keys.join(names.select("repo_id", F.col("ref").alias("_k"), F.col("node_id").alias(out)), ["repo_id", "_k"]).groupBy("repo_id", ref).agg(F.min_by(out, "_p").alias(out))
    return df.join(hit, ["repo_id", ref], "left")


def error_seeds(events: DataFrame) -> DataFrame:
    """Every error event, and task ends with status error."""
    et = F.col("event_type")
    return events.filter(et.startswith("error.") | ((et == "agent.task_end") & (F.col("payload.status") == "error"))).select(
        *SEED, "timestamp_ns", _where(with_error_id=True).alias("source"), F.coalesce("payload.error_type", F.lit("unknown")).alias("error_type"),
        F.coalesce("payload.error_message", F.lit("")).alias("error_message"), F.col("payload.swallowed").alias("told_swallowed")).filter("source IS NOT NULL")


def first_seed_per_node(events: DataFrame) -> DataFrame:
    """Script variant: the first error of each node and run (errors without a node are all kept)."""
    et, st = F.col("event_type"), F.col("payload.status")
    node = F.coalesce(nz(F.col("source_node.node_id")), nz(F.col("payload.node_id")))
    seeds = events.filter(et.isin("error.occurred", "error.propagated") | (et.isin("agent.task_end", "tool.completed") & (st == "error"))).select(*SEED, "timestamp_ns", node.alias("node"))
    named = seeds.filter("node IS NOT NULL").groupBy(*RUN, "node").agg(F.min(F.struct("timestamp_ns", "event_id")).alias("s")).select(*RUN, "s.event_id", "s.timestamp_ns", "node")
    return named.unionByName(seeds.filter("node IS NULL").select(*named.columns))


def trace_errors(events: DataFrame, nodes: DataFrame, order: DataFrame) -> DataFrame:
    """One row per error seed. `order` is graph.breadth_first over the structural edges."""
    et = F.col("event_type")
    names = name_to_id(nodes)
    seeds = cut(_resolve(error_seeds(events), "source", names, "source_sid").withColumn("walk_from", F.coalesce("source_sid", "source")))

    # 1. nodes that err later in the run, in order of their first error after the seed
    active = events.filter(et.isin("agent.task_start", "agent.task_end", "error.occurred", "error.propagated"))
    errs = active.filter(et.startswith("error.") | (F.col("payload.status") == "error")).select(*RUN, "timestamp_ns", _where().alias("node")).filter("node IS NOT NULL")
    erring = errs.groupBy(*RUN, "node").agg(F.max("timestamp_ns").alias("last"))
    cand = seeds.select(*SEED, "timestamp_ns", "source").join(erring, RUN).filter("node <> source AND last > timestamp_ns")
    probes = cand.select(*RUN, "node", "timestamp_ns", "event_id", F.lit(None).cast("long").alias("at"))
    marks = errs.select(*RUN, "node", "timestamp_ns", F.lit(None).cast("string").alias("event_id"), F.col("timestamp_ns").alias("at"))
    hits = scan(probes.unionByName(marks), [*RUN, "node"], "timestamp_ns", {"next_error": ("min", F.col("at"))}, direction="after").filter("event_id IS NOT NULL")
    hits = cut(_resolve(hits.select(*SEED, "node", "next_error"), "node", names, "sid"))

    # 2. structural successors active later without an error of their own
    ref = F.array_distinct(F.array_compact(F.array(_where(), nz(F.col("source_node.node_name")))))
    lively = active.select(*RUN, "timestamp_ns", F.explode(ref).alias("ref")).groupBy(*RUN, "ref").agg(F.max("timestamp_ns").alias("last"))
    lively = _resolve(lively, "ref", names, "node").filter("node IS NOT NULL").groupBy(*RUN, "node").agg(F.max("last").alias("last"))
    ways = order.select("repo_id", F.col("origin").alias("source_sid"), "node", "depth", "via")
    quiet = seeds.filter("source_sid IS NOT NULL").select(*SEED, "timestamp_ns", "source_sid").join(lively, RUN).filter("last > timestamp_ns").join(ways, ["repo_id", "source_sid", "node"])
    quiet = quiet.join(hits.filter("sid IS NOT NULL").select(*SEED, F.col("sid").alias("node")), [*SEED, "node"], "left_anti")

    steps = hits.select(*SEED, F.struct(F.lit(0).alias("part"), F.col("next_error").alias("k"), F.array().cast("array<int>").alias("via"), F.col("node")).alias("step")).unionByName(
        quiet.select(*SEED, F.struct(F.lit(1).alias("part"), F.col("depth").cast("long").alias("k"), F.col("via"), F.col("node")).alias("step")))
    paths = steps.groupBy(*SEED).agg(F.transform(F.array_sort(F.collect_list("step")), lambda s: s["node"]).alias("reached"))
    predicted = order.groupBy("repo_id", F.col("origin").alias("walk_from")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "via", "node"))), lambda s: s["node"]).alias("ahead"))
    none = F.array().cast("array<string>")
    t = seeds.join(paths, SEED, "left").join(predicted, ["repo_id", "walk_from"], "left")
    t = t.withColumn("observed_path", F.concat(F.array("source"), F.coalesce("reached", none))).withColumn("predicted_path", F.concat(F.array("walk_from"), F.coalesce("ahead", none)))
    t = cut(t.drop("reached", "ahead").withColumn("last_node", F.element_at("observed_path", -1)))

    # 3. the first handling at the last node after the seed
    how = F.when(F.col("payload.error_handling").isin("retry", "caught_retry"), "retry").when(F.col("payload.error_handling").isin("caught_silent", "caught_default"), "error_handler").when(et == "guardrail.triggered", "guardrail")
    handled = events.select(*RUN, _where().alias("last_node"), "timestamp_ns", F.lit(None).cast("string").alias("event_id"), how.alias("how")).filter("how IS NOT NULL AND last_node IS NOT NULL")
    ask = t.filter(F.size("observed_path") > 1).select(*RUN, "last_node", "timestamp_ns", "event_id", F.lit(None).cast("string").alias("how"))
    stop = scan(handled.unionByName(ask), [*RUN, "last_node"], "timestamp_ns", {"how": ("nearest", F.col("how"))}, direction="after").filter("event_id IS NOT NULL").select(*SEED, "how")

    # 4. later errors and failed tasks of the run
    later = events.select(*SEED, "timestamp_ns", et.startswith("error.").cast("long").alias("e"), F.coalesce((et == "agent.task_end") & (F.col("payload.status") == "error"), F.lit(False)).cast("long").alias("f")).filter("e + f > 0")
    later = scan(later, RUN, "timestamp_ns", {"downstream_errors": ("sum", F.col("e")), "downstream_tasks_failed": ("sum", F.col("f"))}, direction="after").select(*SEED, "downstream_errors", "downstream_tasks_failed")
    t = t.join(stop, SEED, "left").join(later, SEED, "left")
    alone = F.size("observed_path") <= 1
    return t.select(*SEED, "timestamp_ns", F.col("source").alias("error_source_node"), "error_type", "error_message", "predicted_path", "observed_path",
                    (F.size("observed_path") - 1).alias("nodes_affected"), F.col("last_node").alias("propagation_stopped_by"),
                    F.when(alone, "swallowed_at_source").otherwise(F.coalesce("how", F.lit("end_of_chain"))).alias("stop_mechanism"),
                    F.coalesce("downstream_errors", F.lit(0)).alias("downstream_errors"), F.coalesce("downstream_tasks_failed", F.lit(0)).alias("downstream_tasks_failed"),
                    (F.col("predicted_path") == F.col("observed_path")).alias("structural_prediction_match"), F.coalesce("told_swallowed", alone).alias("swallowed"))


def swallow_flags(events: DataFrame) -> DataFrame:
    """Script variant per error seed: later errors, later failed tasks, and whether it was swallowed."""
    et, st = F.col("event_type"), F.col("payload.status")
    bad_end = et.isin("agent.task_end", "tool.completed") & st.isin("error", "failed")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    rows = events.select(*SEED, "timestamp_ns", flag(et.isin("error.occurred", "error.propagated") | bad_end).alias("err"), flag((et == "agent.task_end") & st.isin("error", "failed")).alias("task_failed"),
                         flag((et == "agent.task_end") & (st == "success")).alias("ok")).filter("err + task_failed + ok > 0")
    counted = scan(rows, RUN, "timestamp_ns", {"later_errors": ("sum", F.col("err")), "later_failed": ("sum", F.col("task_failed")), "later_ok": ("sum", F.col("ok"))}, tie=["event_id"], direction="after")
    return first_seed_per_node(events).join(counted, SEED).select(*SEED, "node", "later_errors", "later_failed", ((F.col("later_errors") == 0) & (F.col("later_ok") > 0)).alias("swallowed"))


def running_depth(events: DataFrame) -> DataFrame:
    """Nesting depth per run as a running +1 / -1 count that never goes below zero; its maximum."""
    et = F.col("event_type")
    up = (et == "delegation.initiated") | ((et == "agent.task_start") & nz(F.col("payload.parent_node_id")).isNotNull())
    steps = events.select(*SEED, "timestamp_ns", F.when(up, 1).when(et == "agent.task_end", -1).alias("d")).filter("d IS NOT NULL")
    cum = scan(steps, RUN, "timestamp_ns", {"cum": ("sum", F.col("d"))}, tie=["event_id"], inclusive=True)
    low = scan(cum, RUN, "timestamp_ns", {"low": ("min", F.col("cum"))}, tie=["event_id"], inclusive=True)
    return low.groupBy(*RUN).agg(F.max(F.col("cum") - F.least(F.lit(0), F.col("low"))).alias("max_depth"))


def swallow_rate(flags: DataFrame) -> DataFrame:
    return flags.groupBy("repo_id").agg(ratio(F.count_if("swallowed"), F.count(F.lit(1))).alias("swallow_rate"))
