"""Behavioral overlay of structural graphs: what nodes, edges and paths did at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spoor.constants import (
    ACTIVATION_END, ACTIVATION_START, EVENT_EDGES, EVENT_ROLES, LATENCY_END, LATENCY_START,
    NODE_ACTIVITY, RUN_ERRORS, SOURCE_RAN, TARGET_RAN,
)
from spoor.functions.ordered import percentiles, scan
from spoor.functions.stats import bool_or, count_if, entropy_term, ratio
from spoor.functions.text import normalize_name, nz, strip_prefixes
from spoor.session import cut
from spoor.operators.resolve import containing, resolve_refs, with_resolved

NODE = ["repo_id", "node_id"]
RUN = ["repo_id", "run_id"]


def run_totals(events: DataFrame) -> DataFrame:
    return events.select(*RUN).distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_runs"))


def with_all_refs(events: DataFrame, ref_map: DataFrame) -> DataFrame:
    """Add src, tgt and agent: resolved structural ids of the three references of an event."""
    agent = F.coalesce(nz(F.col("payload.agent_id")), nz(F.col("payload.agent_name")))
    e = events.withColumn("_agent", F.when(agent.isNotNull(), F.struct(F.lit("").alias("node_id"), agent.alias("node_name"))))
    for side, name in (("source_node", "src"), ("target_node", "tgt"), ("_agent", "agent")):
        e = with_resolved(e, ref_map, side, name)
    return e


def node_events(events: DataFrame, ref_map: DataFrame) -> DataFrame:
    """One row per (event, matched node); roles depend on the event type, nodes are distinct per event."""
    et = F.col("event_type")
    has = lambda role: et.isin([t for t, roles in EVENT_ROLES.items() if role in roles])
    hits = F.array_distinct(F.array_compact(F.array(
        F.col("src"), F.when(has("target"), F.col("tgt")), F.when(has("agent"), F.col("agent")))))
    return with_all_refs(events, ref_map).withColumn("node_id", F.explode(hits)).drop("src", "tgt", "agent", "_agent")


def node_latencies(ne: DataFrame) -> DataFrame:
    """Start-to-end latencies in ms per node: paired by parent id, else the payload's own value."""
    et = F.col("event_type")
    starts = ne.filter(et.isin(LATENCY_START)).select(*NODE, F.col("event_id").alias("parent_event_id"), F.col("timestamp_ns").alias("start_ns"))
    ends = ne.filter(et.isin(LATENCY_END)).select(*NODE, "parent_event_id", "timestamp_ns", F.col("payload.latency_ms").alias("own_ms"))
    hit = ends.alias("e").join(
        starts.alias("s"),
        (F.col("e.repo_id") == F.col("s.repo_id")) & (F.col("e.node_id") == F.col("s.node_id"))
        & (F.col("e.parent_event_id") == F.col("s.parent_event_id")) & (F.col("s.start_ns") <= F.col("e.timestamp_ns")), "left")
    ms = F.coalesce((F.col("timestamp_ns") - F.col("start_ns")) / 1e6, F.when(F.col("own_ms") > 0, F.floor(F.col("own_ms") * 1e6) / 1e6))
    return hit.select("e.repo_id", "e.node_id", ms.alias("latency_ms")).filter("latency_ms IS NOT NULL")


def latency_profile(lat: DataFrame, keys: list[str] = NODE) -> DataFrame:
    p = percentiles(lat, keys, "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.join(lat.groupBy(*keys).agg(F.var_pop("latency_ms").alias("variance"), F.count(F.lit(1)).alias("sample_count")), keys)


def node_run_metrics(ne: DataFrame) -> DataFrame:
    """First aggregation step, per (node, run): plain counts that combine map-side."""
    et, st = F.col("event_type"), F.col("payload.status")
    err = et.isin(RUN_ERRORS) | (et.isin(ACTIVATION_END) & st.isin("error", "failure", "crash"))
    tokens = F.coalesce(F.col("payload.input_tokens"), F.lit(0)) + F.coalesce(F.col("payload.output_tokens"), F.lit(0))
    guard = et == "guardrail.triggered"
    flag = lambda name: F.coalesce(F.col(f"payload.{name}"), F.lit(False))
    return ne.groupBy(*NODE, "run_id").agg(
        count_if(et.isin(ACTIVATION_START)).alias("starts"), count_if(et.isin(ACTIVATION_END)).alias("ends"),
        count_if(et.isin(RUN_ERRORS)).alias("failed"), count_if(err).alias("errors"),
        count_if(et == "error.propagated").alias("propagated"), count_if(err & flag("default_value_used")).alias("defaults"),
        count_if(et == "tool.invoked").alias("tool_calls"),
        count_if((et == "tool.call_failure") | ((et == "tool.completed") & st.isin("error", "failure"))).alias("tool_failures"),
        count_if(flag("is_retry")).alias("retries"),
        count_if(et == "llm.call_start").alias("llm_starts"), count_if(et == "llm.call_end").alias("llm_ends"),
        F.coalesce(F.sum(F.when(et == "llm.call_end", tokens)), F.lit(0)).alias("tokens"),
        count_if(et == "agent.task_start").alias("iterations"),
        count_if(guard).alias("triggers"), count_if(guard & flag("action_prevented")).alias("prevented"),
        count_if(guard & flag("bypassed")).alias("bypassed"), count_if(guard & flag("retry_triggered")).alias("guard_retries"),
        count_if(guard & flag("false_positive")).alias("false_positives"),
        F.sum(F.when(guard, F.col("payload.latency_ms"))).alias("guard_latency"),
        count_if(guard & F.col("payload.latency_ms").isNotNull()).alias("guard_latency_n"),
    )


def error_handling(ne: DataFrame) -> DataFrame:
    """Distinct observed error-handling modes per node, sorted."""
    et, st = F.col("event_type"), F.col("payload.status")
    err = et.isin(RUN_ERRORS) | (et.isin(ACTIVATION_END) & st.isin("error", "failure", "crash"))
    modes = ne.filter(err & nz(F.col("payload.error_handling")).isNotNull()).select(*NODE, F.col("payload.error_handling").alias("mode")).distinct()
    return modes.groupBy(*NODE).agg(F.sort_array(F.collect_set("mode")).alias("observed_error_handling"))


def decision_behavior(ne: DataFrame) -> DataFrame:
    """Entropy, consistency and confidence of a node's decisions, from outcome counts."""
    d = ne.filter(F.col("event_type").isin("decision.made", "decision")).select(
        *NODE, F.coalesce(nz(F.col("payload.selected_option_hash")), F.col("payload.outcome"), F.lit("unknown")).alias("outcome"),
        nz(F.col("payload.input_hash")).alias("input_hash"), F.col("payload.confidence").alias("confidence"))
    cells = d.groupBy(*NODE, "input_hash", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("cs"), F.sum(F.col("confidence") ** 2).alias("cs2"), F.count("confidence").alias("cn"))
    outcomes = cells.groupBy(*NODE, "outcome").agg(*[F.sum(c).alias(c) for c in ("n", "cs", "cs2", "cn")])
    totals = outcomes.groupBy(*NODE).agg(F.sum("n").alias("decisions_made"), F.count(F.lit(1)).alias("unique"), F.sum("cs").alias("cs"), F.sum("cs2").alias("cs2"), F.sum("cn").alias("cn"))
    entropy = outcomes.join(totals.select(*NODE, "decisions_made"), NODE).groupBy(*NODE).agg(F.sum(entropy_term(F.col("n"), F.col("decisions_made"))).alias("decision_entropy"))
    inputs = cells.filter("input_hash IS NOT NULL").groupBy(*NODE, "input_hash").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).filter("n >= 2")
    same = inputs.groupBy(*NODE).agg((count_if(F.col("kinds") == 1) / F.count(F.lit(1))).alias("consistency_same_input"))
    mean = F.col("cs") / F.col("cn")
    return totals.join(entropy, NODE).join(same, NODE, "left").select(
        *NODE, "decisions_made", "decision_entropy", "consistency_same_input",
        (F.col("unique") / F.col("decisions_made")).alias("consistency_diff_input"),
        mean.alias("confidence_mean"), F.greatest(F.lit(0.0), F.col("cs2") / F.col("cn") - mean * mean).alias("confidence_variance"))


def node_behavior(nodes: DataFrame, events: DataFrame, ref_map: DataFrame) -> DataFrame:
    """One row per structural node with all behavioral metrics (zeros where nothing happened)."""
    ne = node_events(events, ref_map)
    runs = run_totals(events)
    per_run = node_run_metrics(ne)
    counts = [c for c in per_run.columns if c not in (*NODE, "run_id", "guard_latency")]
    agg = per_run.groupBy(*NODE).agg(count_if(F.col("starts") > 0).alias("active_runs"), F.sum("guard_latency").alias("guard_latency"), *[F.sum(c).alias(c) for c in counts])
    out = nodes.join(runs, "repo_id").join(agg, NODE, "left").fillna(0, ["active_runs", "guard_latency", *counts])
    out = out.join(latency_profile(node_latencies(ne)), NODE, "left").join(error_handling(ne), NODE, "left").join(decision_behavior(ne), NODE, "left")
    c, runs_n = F.col, F.greatest(F.col("total_runs"), F.lit(1))
    tool_rate = ratio(c("tool_failures"), c("tool_calls"))
    return out.select(
        *NODE, "node_ord", "node_type", "name", "class_name", "error_handling_strategy", "total_runs",
        c("starts").alias("activation_count"), (c("active_runs") / runs_n).alias("activation_rate"),
        c("starts").alias("tasks_received"), c("ends").alias("completed"), "failed", ratio(c("failed"), c("starts")).alias("failure_rate"),
        *[F.coalesce(c(x), F.lit(0.0)).alias(x) for x in ("p50", "p95", "p99", "variance")], F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        c("errors").alias("errors_occurred"), c("propagated").alias("propagated_downstream"), (c("errors") - c("propagated")).alias("swallowed"),
        ratio(c("propagated"), c("errors")).alias("propagation_rate"), c("defaults").alias("default_values_used"),
        F.coalesce("observed_error_handling", F.array().cast("array<string>")).alias("observed_error_handling"),
        "decisions_made", "decision_entropy", "consistency_same_input", "consistency_diff_input", "confidence_mean", "confidence_variance",
        c("tool_failures").alias("tool_call_failures"), tool_rate.alias("tool_call_failure_rate"), c("retries").alias("retry_activations"),
        ((tool_rate > 0.1) | (c("retries") > 0)).alias("quality_dependent"),
        ratio(c("tokens"), c("llm_ends")).alias("avg_tokens"), (c("tool_calls") / runs_n).alias("avg_tool_calls"),
        (c("llm_starts") / runs_n).alias("avg_llm_calls"), (c("iterations") / runs_n).alias("avg_iterations"),
        c("triggers").alias("trigger_count"), "prevented", "bypassed", "guard_retries", "false_positives",
        ratio(c("guard_latency"), c("guard_latency_n")).alias("avg_guard_latency_ms"),
    ).withColumn("structural_prediction_match", F.when(
        nz(F.col("error_handling_strategy")).isNotNull() & (F.size("observed_error_handling") > 0),
        F.array_contains("observed_error_handling", F.col("error_handling_strategy"))))


# ---- edges -------------------------------------------------------------------
SEP = "\x01"


def edge_lookups(events: DataFrame, ref_map: DataFrame) -> DataFrame:
    """Exploded edge lookups of each event: forward pairs, reversed pairs of the expected types,
    and single-endpoint touches. A lookup never repeats an edge of another one of the same event."""
    e = with_all_refs(events, ref_map)
    source, target = F.col("source_node").isNotNull(), F.col("target_node").isNotNull()
    own_agent = F.col("source_node.node_type") == "agent"
    who = {
        "source": (source, F.col("src")), "target": (target, F.col("tgt")),
        "agent": (F.col("_agent").isNotNull() | (source & own_agent), F.when(F.col("_agent").isNotNull(), F.col("agent")).otherwise(F.col("src"))),
    }
    key = lambda a, b: F.concat(a, F.lit(SEP), b)
    fwd, rev, touch = [], [], []
    for et, rules in EVENT_EDGES.items():
        is_t = F.col("event_type") == et
        for a, b, types in rules:
            (ha, ia), (hb, ib) = who[a], who[b]
            both, allowed = is_t & ha & hb, F.array(*[F.lit(t) for t in types])
            fwd.append(F.when(both, key(ia, ib)))
            rev.append(F.when(both, F.struct(key(ib, ia).alias("key"), allowed.alias("types"))))
            one = F.when(ha & ~hb, ia).when(hb & ~ha, ib)
            touch.append(F.when(is_t & one.isNotNull(), F.struct(one.alias("key"), allowed.alias("types"))))
    plain = ~F.col("event_type").isin(list(EVENT_EDGES)) & source & target
    fwd.append(F.when(plain, key(F.col("src"), F.col("tgt"))))
    e = e.withColumn("_fwd", F.array_distinct(F.array_compact(F.array(*fwd))))
    e = e.withColumn("_rev", F.filter(F.array_distinct(F.array_compact(F.array(*rev))), lambda r: r["key"].isNotNull() & ~F.array_contains(F.col("_fwd"), r["key"])))
    none = F.lit(None).cast("array<string>")
    mk = lambda kind, k, types, skip: F.struct(F.lit(kind).alias("kind"), k.alias("key"), types.alias("types"), skip.alias("skip"))
    all_pairs = F.concat(F.col("_fwd"), F.transform("_rev", lambda r: r["key"]))
    looks = F.concat(
        F.transform("_fwd", lambda k: mk("pair", k, none, none)),
        F.transform("_rev", lambda r: mk("pair", r["key"], r["types"], none)),
        F.transform(F.array_distinct(F.array_compact(F.array(*touch))), lambda r: mk("touch", r["key"], r["types"], all_pairs)),
    )
    return e.withColumn("_l", F.explode(looks)).drop("_fwd", "_rev", "src", "tgt", "agent", "_agent")


def edge_events(events: DataFrame, ref_map: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per (event, traversed structural edge)."""
    looks = edge_lookups(events, ref_map).withColumn("_kind", F.col("_l.kind")).withColumn("_key", F.col("_l.key"))
    pair = F.concat("source", F.lit(SEP), "target")
    ek = edges.select("repo_id", "edge_id", "edge_ord", F.col("edge_type").alias("_etype"), pair.alias("_pair"), F.explode(F.array_distinct(F.array(
        F.struct(F.lit("pair").alias("kind"), pair.alias("key")),
        F.struct(F.lit("touch").alias("kind"), F.col("source").alias("key")),
        F.struct(F.lit("touch").alias("kind"), F.col("target").alias("key"))))).alias("k"))
    ek = ek.select("repo_id", "edge_id", "edge_ord", "_etype", "_pair", F.col("k.kind").alias("_kind"), F.col("k.key").alias("_key"))
    hit = looks.join(ek, ["repo_id", "_kind", "_key"])
    ok = (F.col("_l.types").isNull() | F.array_contains("_l.types", F.col("_etype"))) & (F.col("_l.skip").isNull() | ~F.array_contains("_l.skip", F.col("_pair")))
    return hit.filter(ok).drop("_l", "_kind", "_key", "_pair", "_etype")


def first_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (source, target) pair."""
    return edges.groupBy("repo_id", "source", "target").agg(F.min_by("edge_id", "edge_ord").alias("edge_id"))


def propagated_traversals(events: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Error traversals implied by propagation paths and cascade ends, one row per crossed edge."""
    et, p = F.col("event_type"), F.col("payload.propagation_path")
    steps = F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.struct(F.get(p, i).alias("a"), F.get(p, i + 1).alias("b"))))
    hop = F.when(et == "error.propagated", steps).when(
        (et == "error.cascade") & nz(F.col("payload.origin_node")).isNotNull() & nz(F.col("payload.terminal_node")).isNotNull(),
        F.array(F.struct(F.col("payload.origin_node").alias("a"), F.col("payload.terminal_node").alias("b"))))
    hops = events.filter(et.isin("error.propagated", "error.cascade")).select(
        *RUN, "event_type", F.coalesce(F.col("payload.error_type"), F.when(et == "error.cascade", F.lit("cascade")).otherwise(F.lit("unknown_error"))).alias("error_type"),
        ((et == "error.cascade") | F.coalesce(F.col("payload.downstream_impact"), F.lit(False)) | F.coalesce(F.col("payload.reached_irreversible"), F.lit(False))).alias("impact"),
        F.explode(hop).alias("h")).select(*RUN, "event_type", "error_type", "impact", "h.a", "h.b")
    refs = hops.select("repo_id", F.explode(F.array("a", "b")).alias("ref_id")).distinct().withColumn("ref_name", F.col("ref_id"))
    m = resolve_refs(refs, nodes, names_and_types=False)
    for x, out in (("a", "source"), ("b", "target")):
        hops = hops.join(m.select("repo_id", F.col("ref_id").alias(x), F.col("node_id").alias(out)), ["repo_id", x])
    return hops.join(first_edges(edges), ["repo_id", "source", "target"]).select(*RUN, "edge_id", "event_type", "error_type", "impact")


def edge_behavior(edges: DataFrame, nodes: DataFrame, events: DataFrame, ref_map: DataFrame) -> DataFrame:
    """One row per structural edge: traversals, data flow, error crossings, latency, conditions."""
    p = lambda n: F.col(f"payload.{n}")
    flag = lambda n: F.coalesce(p(n), F.lit(False))
    et = F.col("event_type")
    seen = edge_events(events, ref_map, edges).select(
        *RUN, "edge_id", (flag("carries_error") | et.isin("error.propagated", "error.cascade") | nz(p("error_type")).isNotNull()).alias("is_err"),
        nz(p("error_type")).alias("error_type"), (flag("downstream_impact") | flag("reached_irreversible")).alias("impact"),
        p("data_size_bytes").alias("size"), flag("schema_mismatch").alias("mismatch"), (p("data").isNull() | flag("null_data")).alias("null_data"),
        p("latency_ms").alias("latency"), p("condition_result").alias("cond"))
    synth = propagated_traversals(events, nodes, edges).select(
        *RUN, "edge_id", F.lit(True).alias("is_err"), "error_type", "impact", F.lit(None).cast("long").alias("size"), F.lit(False).alias("mismatch"),
        F.lit(True).alias("null_data"), F.lit(None).cast("double").alias("latency"), F.lit(None).cast("boolean").alias("cond"))
    allx = seen.unionByName(synth)
    per_run = allx.groupBy(*RUN, "edge_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.count("size").alias("size_n"), count_if(F.col("mismatch")).alias("mismatch"),
        count_if(F.col("null_data")).alias("null_data"), count_if(F.col("is_err")).alias("errors"), count_if(F.col("is_err") & F.col("impact")).alias("impact"),
        F.sum("latency").alias("latency"), F.count("latency").alias("latency_n"), count_if(F.col("cond")).alias("cond_true"), F.count("cond").alias("cond_n"))
    sums = [c for c in per_run.columns if c not in (*RUN, "edge_id")]
    agg = per_run.groupBy("repo_id", "edge_id").agg(F.count(F.lit(1)).alias("runs"), *[F.sum(c).alias(c) for c in sums])
    types = allx.filter("is_err AND error_type IS NOT NULL").groupBy("repo_id", "edge_id").agg(F.array_join(F.sort_array(F.collect_set("error_type")), ",").alias("error_types"))
    out = edges.join(run_totals(events), "repo_id").join(agg, ["repo_id", "edge_id"], "left").join(types, ["repo_id", "edge_id"], "left").fillna(0, ["runs", *sums])
    c = F.col
    return out.select(
        "repo_id", "edge_id", "edge_ord", "source", "target", "edge_type", c("n").alias("traversal_count"),
        (c("runs") / F.greatest(c("total_runs"), F.lit(1))).alias("activation_rate"), (c("n") == 0).alias("never_activated"),
        ratio(c("size"), c("size_n")).alias("avg_data_size_bytes"), c("mismatch").alias("schema_mismatch_count"), c("null_data").alias("null_data_count"),
        c("errors").alias("errors_traversed"), F.coalesce("error_types", F.lit("")).alias("error_types"), c("impact").alias("downstream_impact"),
        ratio(c("latency"), c("latency_n")).alias("latency_contribution_ms"),
        F.when(c("cond_n") > 0, c("cond_true") / c("cond_n")).alias("condition_true_rate"),
        F.when(c("cond_n") > 0, 1 - c("cond_true") / c("cond_n")).alias("condition_false_rate"))


# ---- edge validation -----------------------------------------------------------
def _id_or_name(ref: str) -> Column:
    return F.coalesce(nz(F.col(f"{ref}.node_id")), nz(F.col(f"{ref}.node_name")))


def activation_pairs(events: DataFrame) -> DataFrame:
    """(repo_id, s, t, n): raw endpoint pairs by event-type rules, counted."""
    et = F.col("event_type")
    direct = et.isin("tool.invoked", "data.read", "data.write", "external.call", "message.received")
    s = F.when(et == "delegation.initiated", F.coalesce(nz(F.col("payload.source_node_id")), _id_or_name("source_node"))).when(
        et == "routing.decision", nz(F.col("payload.source_node"))).when(direct, _id_or_name("source_node"))
    t = F.when(et == "delegation.initiated", F.coalesce(nz(F.col("payload.target_node_id")), _id_or_name("target_node"))).when(
        et == "routing.decision", nz(F.col("payload.target_node"))).when(direct, _id_or_name("target_node"))
    return events.select("repo_id", s.alias("s"), t.alias("t")).filter("s IS NOT NULL AND t IS NOT NULL").groupBy("repo_id", "s", "t").agg(F.count(F.lit(1)).alias("n"))


def fuzzy_ends(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, raw, node): raw references that name a node by equality or containment either way."""
    raw = pairs.select("repo_id", F.explode(F.array("s", "t")).alias("raw")).select("repo_id", "raw", normalize_name(F.col("raw")).alias("raw_norm")).distinct()
    node = edges.select("repo_id", F.explode(F.array("source", "target")).alias("node")).select("repo_id", "node", normalize_name(strip_prefixes(F.col("node"))).alias("node_norm")).distinct()
    near = containing(raw, node, ["repo_id"], "raw_norm", "node_norm").select("repo_id", "raw", "node")
    same = raw.select("repo_id", "raw", F.col("raw").alias("node")).join(node.select("repo_id", "node"), ["repo_id", "node"]).select("repo_id", "raw", "node")
    return near.unionByName(same).distinct()


def edge_activations(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges with their activation count: the exact pair, else the sum over fuzzy pairs."""
    exact = edges.join(pairs.select("repo_id", F.col("s").alias("source"), F.col("t").alias("target"), "n"), ["repo_id", "source", "target"], "left")
    fz = fuzzy_ends(pairs, edges)
    rest = exact.filter("n IS NULL").select("repo_id", "edge_id", "source", "target")
    fuzzy = (
        rest.join(fz.select("repo_id", F.col("node").alias("source"), F.col("raw").alias("s")), ["repo_id", "source"])
        .join(fz.select("repo_id", F.col("node").alias("target"), F.col("raw").alias("t")), ["repo_id", "target"])
        .join(pairs, ["repo_id", "s", "t"]).groupBy("repo_id", "edge_id").agg(F.sum("n").alias("fuzzy_n"))
    )
    return exact.join(fuzzy, ["repo_id", "edge_id"], "left").withColumn("activation_count", F.coalesce("n", "fuzzy_n", F.lit(0))).drop("n", "fuzzy_n")


def mentions(events: DataFrame, types: list[str]) -> DataFrame:
    """(repo_id, key): exact ids and normalised names mentioned by events of some types."""
    refs = F.array_compact(F.array(_id_or_name("source_node"), _id_or_name("target_node"), nz(F.col("payload.node_id")), nz(F.col("payload.error_node_id"))))
    raw = events.filter(F.col("event_type").isin(types)).select("repo_id", F.explode(refs).alias("raw")).distinct()
    return raw.select("repo_id", F.explode(F.array("raw", F.concat(F.lit("~"), normalize_name(F.col("raw"))))).alias("key")).distinct()


def _flag_mention(edges: DataFrame, end: str, keys: DataFrame, name: str) -> DataFrame:
    node = edges.select("repo_id", F.col(end).alias("node")).distinct()
    hit = node.select("repo_id", "node", F.explode(F.array("node", F.concat(F.lit("~"), normalize_name(strip_prefixes(F.col("node")))))).alias("key")).join(keys, ["repo_id", "key"], "left_semi")
    hit = hit.select("repo_id", F.col("node").alias(end)).distinct().withColumn(name, F.lit(True))
    return edges.join(hit, ["repo_id", end], "left").fillna(False, [name])


def edge_validation(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Per edge: activation count and rate, and the reason when the edge is dead."""
    act = edge_activations(edges, activation_pairs(events)).join(run_totals(events), "repo_id")
    act = _flag_mention(act, "source", mentions(events, SOURCE_RAN), "source_ran")
    act = _flag_mention(act, "target", mentions(events, TARGET_RAN), "target_ran")
    routed = events.filter(F.col("event_type") == "routing.decision").select("repo_id", F.col("payload.source_node").alias("source"), F.col("payload.selected_target").alias("target")).filter("target IS NOT NULL").distinct()
    act = act.join(routed.select("repo_id", "source").distinct().withColumn("routes", F.lit(True)), ["repo_id", "source"], "left")
    act = act.join(routed.withColumn("chosen", F.lit(True)), ["repo_id", "source", "target"], "left")
    reason = (
        F.when(~F.col("source_ran"), F.lit("source_never_activated")).when(~F.col("target_ran"), F.lit("target_never_activated"))
        .when(F.col("edge_type") == "shares_with", F.lit("shared_state_not_used"))
        .when(F.col("edge_type").isin("gated_by", "filtered_by"), F.lit("guardrail_never_reached"))
        .when(F.col("routes") & F.col("chosen").isNull(), F.lit("conditional_branch_not_taken")).otherwise(F.lit("path_not_chosen"))
    )
    return act.select("repo_id", "edge_id", "source", "target", "edge_type", "activation_count",
                      (F.col("activation_count") / F.greatest("total_runs", F.lit(1))).alias("activation_rate"),
                      F.when(F.col("activation_count") == 0, reason).alias("dead_reason"))


def dead_reason_text(validated: DataFrame) -> DataFrame:
    """`validated` with a sentence for each dead-edge reason (null for edges that were used)."""
    s, t = F.col("source"), F.col("target")
    saying = {
        "source_never_activated": F.concat(s, F.lit(" never ran")), "target_never_activated": F.concat(t, F.lit(" never ran")), "shared_state_not_used": F.lit("both ends ran, the state between them stayed untouched"),
        "guardrail_never_reached": F.concat(F.lit("no run reached "), t), "conditional_branch_not_taken": F.lit("the router sent every run elsewhere"), "path_not_chosen": F.lit("both ends ran without a handover"),
    }
    text = F.lit(None).cast("string")
    for reason, words in saying.items():
        text = F.when(F.col("dead_reason") == reason, words).otherwise(text)
    return validated.withColumn("dead_reason_text", text)


def activation_by_type(validated: DataFrame) -> DataFrame:
    return validated.groupBy("repo_id", "edge_type").agg(F.count(F.lit(1)).alias("edges"), (count_if(F.col("activation_count") > 0) / F.count(F.lit(1))).alias("activated_share"))


# ---- node activation -------------------------------------------------------------
def node_activation(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Per node: activation rate over runs, always / conditional / never, and what triggers it."""
    name = lambda ref: F.coalesce(nz(F.col(f"{ref}.node_name")), nz(F.col(f"{ref}.node_id")))
    seen = events.filter(F.col("event_type").isin(NODE_ACTIVITY)).select(*RUN, F.explode(F.array_compact(F.array(name("source_node"), name("target_node")))).alias("ref")).distinct()
    refs = seen.select("repo_id", "ref", normalize_name(F.col("ref")).alias("ref_norm")).distinct()
    named = nodes.select("repo_id", "node_id", "node_ord", normalize_name(strip_prefixes(F.col("node_id"))).alias("node_norm")).distinct()
    first = containing(refs, named, ["repo_id"], "ref_norm", "node_norm").groupBy("repo_id", "ref").agg(F.min_by("node_id", "node_ord").alias("node_id"))
    active = seen.join(first, ["repo_id", "ref"]).select("repo_id", "run_id", "node_id").distinct()
    error_runs = events.filter(F.col("event_type").startswith("error.")).select(*RUN).distinct().withColumn("err", F.lit(True))
    agg = active.join(error_runs, RUN, "left").groupBy(*NODE).agg(F.count(F.lit(1)).alias("runs_active"), count_if(F.col("err").isNull()).alias("calm_runs"))
    out = nodes.select(*NODE).join(run_totals(events), "repo_id").join(agg, NODE, "left").fillna(0, ["runs_active", "calm_runs"])
    rate = F.col("runs_active") / F.greatest("total_runs", F.lit(1))
    kind = F.when(rate > 0.95, "always_active").when(rate > 0, "conditional").otherwise("never_active")
    return out.select(*NODE, "runs_active", rate.alias("activation_rate"), kind.alias("category"),
                      F.when((rate > 0) & (rate <= 0.95), F.when(F.col("calm_runs") == 0, "error_triggered").otherwise("input_dependent")).alias("inferred_condition"))


# ---- determinism, paths ------------------------------------------------------------
def input_groups(events: DataFrame) -> DataFrame:
    """(repo_id, run_id, input_group): the first input hash of a run, else the run itself."""
    h = nz(F.col("payload.input_hash"))
    return events.groupBy(*RUN).agg(F.coalesce(F.min_by(h, F.when(h.isNotNull(), F.struct("timestamp_ns", "event_id"))), F.col("run_id")).alias("input_group"))


def determinism(nodes: DataFrame, events: DataFrame, ref_map: DataFrame) -> DataFrame:
    """Same-input agreement of a node's activations over runs, from value frequencies (no run pairs)."""
    groups = input_groups(events)
    sizes = groups.groupBy("repo_id", "input_group").agg(F.count(F.lit(1)).alias("n"))
    acts = node_events(events.filter(F.col("event_type").isin(ACTIVATION_START)), ref_map).groupBy(*NODE, "run_id").agg(F.count(F.lit(1)).alias("k"))
    freq = acts.join(groups, RUN).groupBy(*NODE, "input_group", "k").agg(F.count(F.lit(1)).alias("f"))
    pairs = lambda x: x * (x - 1) / 2
    per = freq.groupBy(*NODE, "input_group").agg(F.sum("f").alias("active"), F.sum(pairs(F.col("f"))).alias("same_k"), F.sum(F.col("f") * F.col("k")).alias("total_k"))
    grid = nodes.select(*NODE).join(sizes, "repo_id").join(per, [*NODE, "input_group"], "left").fillna(0, ["active", "same_k", "total_k"])
    idle = F.col("n") - F.col("active")
    grid = grid.select(*NODE, pairs(F.col("n")).alias("p"), (pairs(F.col("active")) + pairs(idle)).alias("pa"), (F.col("same_k") + pairs(idle)).alias("pk"), (F.col("total_k") / F.col("n")).alias("mean_k"))
    out = grid.groupBy(*NODE).agg(F.sum("p").alias("p"), F.sum("pa").alias("pa"), F.sum("pk").alias("pk"), F.avg("mean_k").alias("m"), F.stddev_pop("mean_k").alias("s"), F.count(F.lit(1)).alias("groups"))
    out = out.join(run_totals(events), "repo_id").filter("total_runs >= 2")
    share = lambda c: F.when(F.col("p") > 0, F.col(c) / F.col("p"))
    return out.select(*NODE, share("pa").alias("same_input_activation_consistency"), share("pk").alias("same_input_path_consistency"),
                      F.when(F.col("groups") >= 2, F.col("s") / F.greatest(F.col("m"), F.lit(1e-9))).otherwise(0.0).alias("cross_input_variance"))


def path_steps(events: DataFrame, ref_map: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, run_id, position, timestamp_ns, edge_id): ordered edge traversals, one per (edge, time)."""
    t = edge_events(events, ref_map, edges).groupBy(*RUN, "timestamp_ns", "edge_id", "edge_ord").agg(F.min("event_id").alias("event_id"))
    return scan(t, RUN, "timestamp_ns", {"position": ("sum", F.lit(1))}, tie=["event_id", "edge_ord"]).select(*RUN, "position", "timestamp_ns", "edge_id")


def path_signatures(steps: DataFrame, events: DataFrame) -> DataFrame:
    """(repo_id, run_id, signature): an order-sensitive hash sum, so no run's path is gathered."""
    h = F.xxhash64("edge_id", "position").cast("decimal(38,0)")
    h2 = F.xxhash64(F.lit("again"), "position", "edge_id").cast("decimal(38,0)")
    sig = steps.groupBy(*RUN).agg(F.concat_ws("/", F.sum(h), F.sum(h2), F.count(F.lit(1))).alias("signature"))
    return events.select(*RUN).distinct().join(sig, RUN, "left").fillna("", ["signature"])


def path_analysis(steps: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct paths and the share of the most frequent one, per repository."""
    per = path_signatures(steps, events).groupBy("repo_id", "signature").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("repo_id").agg(F.count(F.lit(1)).alias("distinct_paths"), (F.max("n") / F.sum("n")).alias("dominant_path_frequency"))


def conditional_edges(steps: DataFrame, events: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that fire in some but not all runs, with the node where paths diverge."""
    per = steps.select(*RUN, "edge_id").distinct().groupBy("repo_id", "edge_id").agg(F.count(F.lit(1)).alias("runs"))
    out = per.join(run_totals(events), "repo_id").filter("runs < total_runs").join(edges.select("repo_id", "edge_id", "source"), ["repo_id", "edge_id"])
    return out.select("repo_id", "edge_id", F.col("source").alias("divergence_node"), (F.col("runs") / F.col("total_runs")).alias("activation_rate"))


# ---- failures ------------------------------------------------------------------------
def failure_impacts(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Per capability with failed calls: later errors, spread to other agents, recovery, silent degradation.

    Everything after a failure is read from running sums over the run (and over the run and
    agent, to tell other agents' events apart), never from pairs of events.
    """
    et, pl = F.col("event_type"), lambda n: F.col(f"payload.{n}")
    norm = lambda c: F.coalesce(normalize_name(c), F.lit(""))
    src_name, src_id = F.coalesce(F.col("source_node.node_name"), F.lit("")), F.coalesce(F.col("source_node.node_id"), F.lit(""))
    base = events.select(
        *RUN, "event_id", "timestamp_ns", "event_type", src_id.alias("src_id"), norm(src_name).alias("who_name"),
        norm(F.coalesce(nz(src_name), src_id)).alias("who"), norm(pl("tool_name")).alias("tool"), norm(pl("agent_id")).alias("invoker"),
        ((et == "tool.call_failure") | ((et == "tool.completed") & pl("status").isin("error", "failure"))).alias("fails"),
        et.isin("error.occurred", "error.propagated", "error.cascade").alias("err3"),
        et.isin("error.occurred", "error.propagated").alias("err2"), et.isin("agent.task_start", "agent.task_end").alias("task"),
        (F.coalesce(pl("is_retry"), F.lit(False)) | ((et == "tool.completed") & (pl("status") == "success"))).alias("recovers"),
    ).fillna(False, ["fails", "recovers"])
    one = lambda c: c.cast("long")
    known = F.col("who") != ""
    later = scan(base, RUN, "timestamp_ns", {
        "later_err3": ("sum", one(F.col("err3"))), "later_named": ("sum", one(F.col("err3") & known)),
        "later_err2": ("sum", one(F.col("err2"))), "later_task": ("sum", one(F.col("task"))),
    }, tie=["event_id"], direction="after").filter("fails")
    # the invoker's own later events
    own = base.filter("err3 OR err2 OR task").select(*RUN, "event_id", "timestamp_ns", F.explode(F.array(
        F.struct(F.lit("w").alias("kind"), F.col("who").alias("agent"), one(F.col("err3")).alias("e3"), F.lit(0).cast("long").alias("e2"), F.lit(0).cast("long").alias("tk")),
        F.struct(F.lit("n").alias("kind"), F.col("who_name").alias("agent"), F.lit(0).cast("long").alias("e3"), one(F.col("err2")).alias("e2"), one(F.col("task")).alias("tk")))).alias("x"))
    own = own.select(*RUN, "event_id", "timestamp_ns", "x.*", F.lit(False).alias("probe"))
    zero = F.lit(0).cast("long")
    probes = base.filter("fails").select(*RUN, "event_id", "timestamp_ns", F.explode(F.array(F.lit("w"), F.lit("n"))).alias("kind"), F.col("invoker").alias("agent"), zero.alias("e3"), zero.alias("e2"), zero.alias("tk"), F.lit(True).alias("probe"))
    mine = scan(own.unionByName(probes), [*RUN, "kind", "agent"], "timestamp_ns", {
        "own3": ("sum", F.col("e3")), "own2": ("sum", F.col("e2")), "ownt": ("sum", F.col("tk"))}, tie=["event_id"], direction="after").filter("probe")
    mine = mine.groupBy(*RUN, "event_id").agg(F.max(F.when(F.col("kind") == "w", F.col("own3"))).alias("own3"), F.max(F.when(F.col("kind") == "n", F.col("own2"))).alias("own2"), F.max(F.when(F.col("kind") == "n", F.col("ownt"))).alias("ownt"))
    hits = later.join(mine, [*RUN, "event_id"])
    # which capability failed: by id, or by name of the source or the tool
    caps = nodes.filter("node_type = 'capability'").select("repo_id", "node_id", norm(F.coalesce(nz(F.col("name")), F.col("class_name"))).alias("cap"))
    keys = caps.select("repo_id", "node_id", "cap", F.explode(F.array(F.col("node_id"), F.concat(F.lit("~"), F.col("cap")))).alias("key"))
    failed = hits.withColumn("key", F.explode(F.array_distinct(F.array(F.col("src_id"), F.concat(F.lit("~"), F.col("who")), F.concat(F.lit("~"), F.col("tool"))))))
    failed = cut(failed.join(keys, ["repo_id", "key"]).dropDuplicates([*NODE, "run_id", "event_id"]))
    # first later recovery of the same tool
    rec = base.filter("recovers").select(*RUN, F.col("tool").alias("cap"), "event_id", "timestamp_ns", F.col("timestamp_ns").alias("at"), F.lit("").alias("node_id"))
    ask = failed.select(*RUN, "cap", "event_id", "timestamp_ns", F.lit(None).cast("long").alias("at"), "node_id")
    back = scan(rec.unionByName(ask), [*RUN, "cap"], "timestamp_ns", {"recovered_at": ("nearest", F.col("at"))}, tie=["event_id"], direction="after").filter("node_id <> ''")
    all_ = failed.join(back.select(*RUN, "node_id", "event_id", "recovered_at"), [*RUN, "node_id", "event_id"])
    dt = (F.col("recovered_at") - F.col("timestamp_ns")) / 1e6
    return all_.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("failures"), F.sum("later_err3").alias("downstream_degradation_count"),
        bool_or((F.col("invoker") != "") & (F.col("later_named") - F.col("own3") > 0)).alias("cascade_to_other_agents"),
        bool_or(F.col("recovered_at").isNotNull()).alias("recovery_observed"),
        F.coalesce(F.avg(F.when(dt > 0, dt)), F.lit(0.0)).alias("avg_recovery_time_ms"),
        count_if((F.col("later_task") - F.col("ownt") > 0) & (F.col("later_err2") - F.col("own2") == 0)).alias("silent_degradation_count"))


def cascades(behavior: DataFrame, far: DataFrame) -> DataFrame:
    """Per erring node: erring nodes downstream. `far` is graph.reach; walks pass through calm nodes."""
    bad = behavior.filter("errors_occurred > 0").select("repo_id", "node_id", "errors_occurred")
    hit = far.join(bad.select("repo_id", F.col("node_id").alias("node"), F.col("errors_occurred").alias("n")), ["repo_id", "node"])
    agg = hit.groupBy("repo_id", F.col("origin").alias("node_id")).agg(F.max("depth").alias("cascade_depth"), F.count(F.lit(1)).alias("nodes_affected"), F.sum("n").alias("total_downstream_errors"))
    return bad.join(agg, NODE, "left").fillna(0).select("repo_id", F.col("node_id").alias("origin_node"), F.col("errors_occurred").alias("origin_errors"), "cascade_depth", "nodes_affected", "total_downstream_errors")


def cascade_summary(casc: DataFrame) -> DataFrame:
    return casc.groupBy("repo_id").agg(F.max("cascade_depth").alias("max_cascade_depth"), F.avg("cascade_depth").alias("avg_cascade_depth"),
                                       (count_if(F.col("cascade_depth") > 0) / F.count(F.lit(1))).alias("cascading_failure_rate"))


def unmapped_counts(events: DataFrame, ref_map: DataFrame, edges: DataFrame) -> DataFrame:
    """Events that match no node, and edge-like events that match no edge, per repository."""
    edge_like = F.col("event_type").isin(list(EVENT_EDGES)) | (F.col("source_node").isNotNull() & F.col("target_node").isNotNull())
    n_total = events.groupBy("repo_id").agg(F.count(F.lit(1)).alias("events"), count_if(edge_like).alias("edge_like"))
    hit_nodes = node_events(events, ref_map).select("repo_id", "event_id").distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("on_nodes"))
    hit_edges = edge_events(events, ref_map, edges).select("repo_id", "event_id").distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("on_edges"))
    out = n_total.join(hit_nodes, "repo_id", "left").join(hit_edges, "repo_id", "left").fillna(0)
    return out.select("repo_id", (F.col("events") - F.col("on_nodes")).alias("unmapped_node_events"), (F.col("edge_like") - F.col("on_edges")).alias("unmapped_edge_events"))


