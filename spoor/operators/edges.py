"""Emergent edges (seen at run time, absent from the graph) and dead edges (the reverse)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spoor.functions.stats import bool_or, ratio
from spoor.functions.text import normalize_name, nz, strip_prefixes
from spoor.operators.overlay import run_totals
from spoor.operators.resolve import containing, with_resolved
from spoor.session import cut

RUN = ["repo_id", "run_id"]
FIVE_SECONDS = 5_000_000_000


def _raw(ref: str) -> Column:
    return F.coalesce(nz(F.col(f"{ref}.node_id")), nz(F.col(f"{ref}.node_name")))


def interactions(events: DataFrame, raw_map: DataFrame) -> DataFrame:
    """Events with their resolved (else raw) endpoint ids s and t; null where an end is missing."""
    e = with_resolved(with_resolved(events, raw_map, "source_node", "_s"), raw_map, "target_node", "_t")
    return e.withColumn("s", F.coalesce("_s", _raw("source_node"))).withColumn("t", F.coalesce("_t", _raw("target_node"))).drop("_s", "_t")


def edge_type_of(edge_type: Column, event_type: Column) -> Column:
    return F.coalesce(nz(edge_type), F.when(event_type.contains("delegat"), "delegates_to").when(event_type.contains("tool"), "calls")
                      .when(event_type.contains("read"), "reads_from").when(event_type.contains("write"), "writes_to").otherwise("unknown"))


def emergent_edges(events: DataFrame, raw_map: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Runtime pairs without a structural edge: count, rate, usual type, triggers, significance."""
    key = ["repo_id", "s", "t"]
    seen = interactions(events, raw_map).filter("s IS NOT NULL AND t IS NOT NULL").select(
        *key, edge_type_of(F.col("edge_type"), F.col("event_type")).alias("type"), nz(F.col("payload.trigger")).alias("trigger"), "timestamp_ns",
        (F.col("edge_type").isin("writes_to", "sends_to", "calls") | F.coalesce(F.col("payload.irreversible"), F.lit(False))).alias("irreversible"))
    known = edges.select("repo_id", F.col("source").alias("s"), F.col("target").alias("t")).distinct()
    typed = seen.groupBy(*key, "type").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_ns").alias("first"), bool_or(F.col("irreversible")).alias("irreversible"))
    pairs = typed.groupBy(*key).agg(
        F.sum("n").alias("traversal_count"), F.max_by("type", F.struct(F.col("n"), -F.col("first"), F.col("type"))).alias("edge_type"), bool_or(F.col("irreversible")).alias("irreversible"))
    pairs = pairs.join(known, key, "left_anti")
    triggers = seen.filter("trigger IS NOT NULL").select(*key, "trigger").distinct().groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("trigger")), "; ").alias("trigger_condition"))
    ids = nodes.select("repo_id", F.col("node_id"), F.lit(True).alias("known"))
    for end in ("s", "t"):
        pairs = pairs.join(ids.select("repo_id", F.col("node_id").alias(end), F.col("known").alias(f"known_{end}")), ["repo_id", end], "left")
    out = pairs.join(run_totals(events), "repo_id").join(triggers, key, "left")
    unknown = F.col("known_s").isNull() | F.col("known_t").isNull()
    return out.select("repo_id", F.col("s").alias("source"), F.col("t").alias("target"), "edge_type", "traversal_count", ratio(F.col("traversal_count"), F.col("total_runs")).alias("activation_rate"),
                      "trigger_condition", F.when(unknown | F.col("irreversible"), "high").when(F.col("traversal_count") <= 2, "low").otherwise("medium").alias("significance"))


def dead_edges(events: DataFrame, raw_map: DataFrame, edges: DataFrame) -> DataFrame:
    """Structural edges never traversed, with the possible reasons."""
    seen = interactions(events, raw_map).select("repo_id", "s", "t", F.col("source_node").isNotNull().alias("hs"), F.col("target_node").isNotNull().alias("ht"))
    pairs = seen.filter("s IS NOT NULL AND t IS NOT NULL").select("repo_id", F.col("s").alias("source"), F.col("t").alias("target")).distinct()
    single = seen.filter("hs <> ht").select("repo_id", F.coalesce("s", "t").alias("node")).filter("node IS NOT NULL").distinct()
    left = edges.join(pairs, ["repo_id", "source", "target"], "left_anti")
    touched = left.select("repo_id", "edge_id", "edge_type", F.explode(F.array("source", "target")).alias("node")).filter(F.col("edge_type").isin("guarded_by", "filtered_by"))
    alive = touched.join(single, ["repo_id", "node"], "left_semi").select("repo_id", "edge_id").distinct()
    dead = left.join(alive, ["repo_id", "edge_id"], "left_anti").join(run_totals(events), "repo_id")
    found = F.array_compact(F.array(
        F.when(nz(F.col("condition")).isNotNull(), "conditional_never_true"), F.when(F.col("edge_type").isin("gated_by", "filtered_by"), "conditional_never_true"),
        F.when(F.col("total_runs") < 5, "input_dependent")))
    reasons = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("dead_code"), F.lit("input_dependent")))
    return dead.select("repo_id", "edge_id", "source", "target", "edge_type", F.col("total_runs").alias("runs_observed"), F.array_join(reasons, ",").alias("possible_reasons"))


# ---- second version: by discovery type ------------------------------------------
def fuzzy_known(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (repo_id, s, t) that match a structural edge by equal or contained normalised names."""
    raw = pairs.select("repo_id", F.explode(F.array("s", "t")).alias("raw")).select("repo_id", "raw", normalize_name(F.col("raw")).alias("raw_norm")).distinct()
    short = strip_prefixes(F.col("node"), ["agent_", "cap_"])
    node = edges.select("repo_id", F.explode(F.array("source", "target")).alias("node")).select("repo_id", "node", normalize_name(short).alias("node_norm")).distinct()
    near = containing(raw, node, ["repo_id"], "raw_norm", "node_norm").select("repo_id", "raw", "node").distinct()
    a = near.select("repo_id", F.col("raw").alias("s"), F.col("node").alias("source"))
    b = near.select("repo_id", F.col("raw").alias("t"), F.col("node").alias("target"))
    arcs = edges.select("repo_id", "source", "target").distinct()
    return pairs.select("repo_id", "s", "t").join(a, ["repo_id", "s"]).join(arcs, ["repo_id", "source"]).join(b, ["repo_id", "t", "target"]).select("repo_id", "s", "t").distinct()


def near_errors(points: DataFrame, events: DataFrame, within_ns: int = FIVE_SECONDS) -> DataFrame:
    """Points (repo_id, ..., timestamp_ns) with an error of the repository closer than `within_ns`.

    Both sides are cut into slots of that width; a point looks at its own slot and the two beside it.
    """
    slot = F.floor(F.col("timestamp_ns") / within_ns)
    errs = events.filter(F.col("event_type").startswith("error.")).select("repo_id", slot.alias("_slot"), F.col("timestamp_ns").alias("_err")).groupBy("repo_id", "_slot").agg(F.min("_err").alias("_lo"), F.max("_err").alias("_hi"))
    look = points.withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    own = F.col("_slot") == slot
    close = own | (F.col("timestamp_ns") - F.col("_hi")).between(0, within_ns - 1) | (F.col("_lo") - F.col("timestamp_ns")).between(0, within_ns - 1)
    return look.join(errs, ["repo_id", "_slot"]).filter(close).select(*points.columns).distinct()


def emergent_by_discovery(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Undeclared delegations, implicit state sharing and routing targets, with discovery type and texts."""
    known = edges.select("repo_id", F.col("source").alias("s"), F.col("target").alias("t")).distinct()
    runs = run_totals(events)
    p = lambda n: nz(F.col(f"payload.{n}"))
    dl = events.filter(F.col("event_type") == "delegation.initiated").select(
        "repo_id", "event_id", "timestamp_ns", F.coalesce(p("source_node_id"), _raw("source_node")).alias("s"), F.coalesce(p("target_node_id"), _raw("target_node")).alias("t"),
        F.col("payload.delegation_type").alias("delegation_type"), F.array_distinct(F.array_compact(F.array(p("source_node_id"), nz(F.col("source_node.node_name"))))).alias("sk"),
        F.array_distinct(F.array_compact(F.array(p("target_node_id"), nz(F.col("target_node.node_name"))))).alias("tk"))
    first = dl.filter("s IS NOT NULL AND t IS NOT NULL").groupBy("repo_id", "s", "t").agg(
        F.min(F.struct("timestamp_ns", "event_id")).alias("at"), F.min_by("delegation_type", F.struct("timestamp_ns", "event_id")).alias("delegation_type"))
    first = cut(first.join(known, ["repo_id", "s", "t"], "left_anti"))
    first = cut(first.join(fuzzy_known(first, edges), ["repo_id", "s", "t"], "left_anti")).select("repo_id", "s", "t", F.col("at.timestamp_ns").alias("timestamp_ns"), "delegation_type")
    hot = near_errors(first, events).select("repo_id", "s", "t").withColumn("err", F.lit(True))
    counts = dl.select("repo_id", F.explode("sk").alias("s"), "tk").select("repo_id", "s", F.explode("tk").alias("t")).groupBy("repo_id", "s", "t").agg(F.count(F.lit(1)).alias("activation_count"))
    deleg = first.join(hot, ["repo_id", "s", "t"], "left").join(counts, ["repo_id", "s", "t"], "left").select(
        "repo_id", "s", "t", F.lit("delegates_to").alias("edge_type"), F.coalesce("activation_count", F.lit(0)).alias("activation_count"),
        F.when(F.col("err"), "error_triggered_fallback").when(F.col("delegation_type") == "framework_internal", "framework_internal_routing").otherwise("dynamic_delegation").alias("discovery_type"),
        F.lit(None).cast("string").alias("shared_state_key"), F.lit(None).cast("string").alias("basis"), F.lit(None).cast("string").alias("routing_type"))
    shares = implicit_sharing(events, edges).select("repo_id", F.col("writer").alias("s"), F.col("reader").alias("t"), F.lit("shares_with").alias("edge_type"), F.col("interaction_count").alias("activation_count"),
                                                   F.lit("implicit_data_sharing").alias("discovery_type"), F.col("state_key").alias("shared_state_key"), F.lit(None).cast("string").alias("basis"), F.lit(None).cast("string").alias("routing_type"))
    rt = events.filter((F.col("event_type") == "routing.decision") & p("source_node").isNotNull() & F.coalesce(p("target_node"), p("selected_target")).isNotNull()).groupBy(
        "repo_id", p("source_node").alias("s"), F.coalesce(p("target_node"), p("selected_target")).alias("t")).agg(
        F.min_by(F.struct(F.coalesce("payload.decision_basis", F.lit("unknown")).alias("basis"), F.coalesce("payload.routing_type", F.lit("unknown")).alias("routing_type")), F.struct("timestamp_ns", "event_id")).alias("f"))
    rt = cut(rt.join(known, ["repo_id", "s", "t"], "left_anti").join(first, ["repo_id", "s", "t"], "left_anti"))
    rt = rt.join(fuzzy_known(rt, edges), ["repo_id", "s", "t"], "left_anti").select(
        "repo_id", "s", "t", F.lit("delegates_to").alias("edge_type"), F.lit(1).cast("long").alias("activation_count"),
        F.when(F.col("f.basis") == "llm_output", "dynamic_delegation").otherwise("framework_internal_routing").alias("discovery_type"),
        F.lit(None).cast("string").alias("shared_state_key"), F.col("f.basis").alias("basis"), F.col("f.routing_type").alias("routing_type"))
    all_ = deleg.unionByName(shares).unionByName(rt).join(runs, "repo_id")
    return all_.select("repo_id", F.col("s").alias("source"), F.col("t").alias("target"), "edge_type", "activation_count",
                       ratio(F.col("activation_count"), F.col("total_runs")).alias("activation_rate"), "discovery_type", "shared_state_key",
                       trigger_text().alias("trigger_condition"), heuristic_text().alias("detection_heuristic"))


def trigger_text() -> Column:
    return (
        F.when(F.col("basis").isNotNull(), F.format_string("routing decision (%s) based on %s", "routing_type", "basis"))
        .when(F.col("shared_state_key").isNotNull(), F.format_string("both agents access state key '%s'", "shared_state_key"))
        .when(F.col("discovery_type") == "error_triggered_fallback", "error in upstream node triggered fallback delegation")
        .when(F.col("discovery_type") == "framework_internal_routing", "framework orchestrator created routing path")
        .otherwise("LLM-chosen or dynamic routing decision"))


def heuristic_text() -> Column:
    """What to watch for, or what edge to add, for an edge found at run time."""
    s, t, say = F.col("s"), F.col("t"), F.format_string
    return (
        F.when(F.col("basis").isNotNull(), say("The router (%s, by %s) sends '%s' to '%s'; no structural edge says so.", "routing_type", "basis", s, t))
        .when(F.col("shared_state_key").isNotNull(), say("State key '%s' joins %s and %s; a shares_with edge would show it.", "shared_state_key", s, t))
        .when(F.col("discovery_type") == "error_triggered_fallback", say("Watch for '%s' taking over when '%s' fails; add a conditional delegates_to edge for errors.", t, s))
        .when(F.col("discovery_type") == "dynamic_delegation", say("Watch what the model routes from '%s' to '%s'; add a dynamic delegates_to edge.", s, t))
        .otherwise(say("The framework itself routes '%s' to '%s'; user code does not name this path.", s, t)))


def implicit_sharing(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Writer and reader nodes of one state key without an edge; accesses are counted per node first."""
    acc = events.filter((F.col("event_type") == "state.access") & nz(F.col("payload.node_id")).isNotNull() & nz(F.col("payload.state_key")).isNotNull()).groupBy(
        "repo_id", F.col("payload.state_key").alias("state_key"), F.col("payload.node_id").alias("node")).agg(
        F.count_if(F.col("payload.access_type").isin("write", "read_write")).alias("w"), F.count_if(F.col("payload.access_type").isin("read", "read_write")).alias("r"))
    totals = acc.groupBy("repo_id", "state_key").agg(F.least(F.sum("w"), F.sum("r")).alias("interaction_count"))
    w = acc.filter("w > 0").select("repo_id", "state_key", F.col("node").alias("writer"))
    r = acc.filter("r > 0").select("repo_id", "state_key", F.col("node").alias("reader"))
    known = edges.select("repo_id", F.col("source").alias("writer"), F.col("target").alias("reader")).distinct()
    return w.join(r, ["repo_id", "state_key"]).filter("writer <> reader").join(known, ["repo_id", "writer", "reader"], "left_anti").join(totals, ["repo_id", "state_key"]).select("repo_id", "writer", "reader", "state_key", "interaction_count")


# ---- edges as the events spell them out ---------------------------------------------
def runtime_edges(events: DataFrame) -> DataFrame:
    """(repo_id, run_id, source, target, edge_type): one row per edge an event implies; open ends dropped."""
    et, p, sid = F.col("event_type"), lambda n: F.col(f"payload.{n}"), F.col("source_node.node_id")
    arc = lambda cond, s, t, kind: F.when(cond, F.struct(s.alias("source"), t.alias("target"), kind.alias("edge_type")))
    shapes = F.array(
        arc(et == "agent.task_start", p("parent_node_id"), sid, F.lit("delegates_to")), arc(et == "agent.task_start", p("input_source"), sid, F.lit("reads_from")),
        arc(et == "llm.call_end", F.try_element_at(p("active_node_stack"), F.lit(-1)), sid, F.lit("calls")), arc(et == "tool.invoked", sid, p("tool_node_id"), F.lit("uses")),
        arc(et == "state.access", p("accessor_node"), p("state_key"), F.when(p("access_type") == "write", "writes_to").otherwise("reads_from")),
        arc((et == "delegation.initiated") & F.col("target_node").isNotNull(), sid, F.col("target_node.node_id"), F.lit("delegates_to")),
        arc(et == "routing.decision", p("source_node"), p("selected_target"), F.lit("delegates_to")))
    e = events.select(*RUN, "timestamp_ns", "event_id", F.explode(F.array_compact(shapes)).alias("x")).select(*RUN, "timestamp_ns", "event_id", "x.*")
    return e.filter(nz(F.col("source")).isNotNull() & nz(F.col("target")).isNotNull())


def node_category() -> Column:
    """Structural category of an event's source node by type, name and event rules."""
    name, et, nt = F.lower(F.coalesce(F.col("source_node.node_name"), F.lit(""))), F.col("event_type"), F.col("source_node.node_type")
    return (
        F.when(name.contains("crew") | (et == "execution.start"), "orchestrator").when((nt == "capability") | et.startswith("llm."), "capability")
        .when(name.contains("tool") | et.startswith("tool."), "capability").when(et.startswith("agent."), "agent")
        .when(name.contains("state") | name.contains("store"), "data_store").when(name.contains("guard") | name.contains("review"), "guard").otherwise("agent"))


def first_runs(events: DataFrame) -> DataFrame:
    return events.groupBy("repo_id").agg(F.min("run_id").alias("run_id"))


def inferred_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph inferred from each repository's first run."""
    one = events.join(first_runs(events), RUN, "left_semi")
    at = F.struct("timestamp_ns", "event_id")
    nodes = one.filter(nz(F.col("source_node.node_id")).isNotNull()).groupBy("repo_id", F.col("source_node.node_id").alias("node_id")).agg(
        F.min_by(node_category(), at).alias("node_type"), F.min_by(F.col("source_node.node_name"), at).alias("name"))
    edges = runtime_edges(one).groupBy("repo_id", "source", "target", "edge_type").agg(F.min(F.struct("timestamp_ns", "event_id")).alias("first"))
    edges = edges.withColumn("edge_id", F.concat(F.lit("e"), F.substring(F.sha2(F.concat_ws("|", "source", "target", "edge_type"), 256), 1, 12)))
    return nodes, edges.select("repo_id", "edge_id", "source", "target", "edge_type")


def run_edge_validation(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Runs in which each edge fired (pair, and type where the edge has one), and reasons for dead edges."""
    fired = runtime_edges(events).select(*RUN, "source", "target", F.col("edge_type").alias("seen")).distinct()
    hit = edges.join(fired, ["repo_id", "source", "target"]).filter((F.coalesce("edge_type", F.lit("")) == "") | (F.col("edge_type") == F.col("seen")))
    n = hit.groupBy("repo_id", "edge_id").agg(F.count_distinct("run_id").alias("traversal_count"))
    seen = events.select("repo_id", F.explode(F.array("source_node.node_id", "target_node.node_id")).alias("node")).filter("node <> ''").distinct()
    out = edges.join(run_totals(events), "repo_id").join(n, ["repo_id", "edge_id"], "left").fillna(0, ["traversal_count"])
    for end in ("source", "target"):
        out = out.join(seen.select("repo_id", F.col("node").alias(end), F.lit(True).alias(f"{end}_seen")), ["repo_id", end], "left")
    s, t = F.col("source_seen").isNotNull(), F.col("target_seen").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(~s, F.concat(F.lit("source_node_never_activated:"), F.col("source"))), F.when(~t, F.concat(F.lit("target_node_never_activated:"), F.col("target"))),
        F.when(s & t, F.lit("nodes_active_but_edge_never_traversed")), F.when(F.col("edge_type").isin("guards", "reviews"), F.lit("guard_edge_may_be_bypass_only"))))
    return out.select("repo_id", "edge_id", "source", "target", "edge_type", "traversal_count", ratio(F.col("traversal_count"), F.col("total_runs")).alias("activation_rate"),
                      F.when(F.col("traversal_count") == 0, F.array_join(reasons, ",")).alias("possible_reasons"))


def run_emergent_edges(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Triples absent from the graph with the number of runs that show them."""
    seen = runtime_edges(events).select(*RUN, "source", "target", "edge_type").distinct()
    new = seen.join(edges.select("repo_id", "source", "target").distinct(), ["repo_id", "source", "target"], "left_anti")
    n = new.groupBy("repo_id", "source", "target", "edge_type").agg(F.count(F.lit(1)).alias("observed_in_runs")).join(run_totals(events), "repo_id")
    return n.select("repo_id", "source", "target", "edge_type", "observed_in_runs", ratio(F.col("observed_in_runs"), F.col("total_runs")).alias("observation_rate"),
                    F.when(F.col("observed_in_runs") == F.col("total_runs"), "consistent").otherwise("intermittent").alias("classification"))


def run_node_activation(node_ids: DataFrame, events: DataFrame) -> DataFrame:
    """always / conditional / never by the number of runs in which a node id occurs."""
    seen = events.select(*RUN, F.explode(F.array("source_node.node_id", "target_node.node_id")).alias("node_id")).filter("node_id <> ''").distinct()
    n = seen.groupBy("repo_id", "node_id").agg(F.count(F.lit(1)).alias("runs_active"))
    out = node_ids.select("repo_id", "node_id").distinct().join(run_totals(events), "repo_id").join(n, ["repo_id", "node_id"], "left").fillna(0, ["runs_active"])
    return out.select("repo_id", "node_id", "runs_active", F.when(F.col("runs_active") == F.col("total_runs"), "always_active").when(F.col("runs_active") > 0, "conditional").otherwise("never_active").alias("category"))
