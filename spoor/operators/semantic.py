"""Semantic passes: which outputs and inputs to compare, and scores of judged answers.

The judge itself is outside: its answers arrive as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spoor.functions.ordered import scan
from spoor.functions.text import nz
from spoor.functions.stats import count_if
from spoor.session import land

RUN = ["repo_id", "run_id"]
NID = "source_node.node_id"


def explicit_delegations(events: DataFrame) -> DataFrame:
    """Initiated delegations with the first completion of the same id that follows in the run."""
    key = F.coalesce(nz(F.col("payload.delegation_id")), F.col("event_id"))
    d = events.filter(F.col("event_type").isin("delegation.initiated", "delegation.completed")).select(
        *RUN, key.alias("did"), "event_id", "timestamp_ns", (F.col("event_type") == "delegation.completed").alias("done"), F.col(NID).alias("node"), F.col("target_node.node_id").alias("target"))
    # the last initiation before a completion, unless another completion lies in between
    last = F.struct("event_id", "timestamp_ns", "node", "done")
    s = scan(d.withColumn("_here", last), [*RUN, "did"], "timestamp_ns", {"before": ("nearest", F.col("_here"))}, tie=["event_id"])
    return s.filter("done AND before IS NOT NULL AND NOT before.done").select(*RUN, F.col("before.event_id").alias("initiated_id"), F.col("event_id").alias("completed_id"), F.col("before.node").alias("source"), "target")


def inferred_delegations(events: DataFrame) -> DataFrame:
    """Each task end with the next task start of another node in the run.

    The next start of any node, and per node the next start, tell the next start of another
    node: it is the first start after the end whose node differs. Starts are reduced to the
    changes of node first, so one look ahead past the own node's starts suffices.
    """
    e = events.filter(F.col("event_type").isin("agent.task_start", "agent.task_end")).select(*RUN, "event_id", "timestamp_ns", (F.col("event_type") == "agent.task_start").alias("start"), F.coalesce(F.col(NID), F.lit("")).alias("node"))
    at = F.struct("timestamp_ns", "event_id", "node")
    s = scan(e.withColumn("_at", at), RUN, "timestamp_ns", {"nxt": ("nearest", F.when(F.col("start"), F.col("_at")))}, direction="after")
    # second look: from a start, the next start of a different node (null where the next one differs by itself)
    starts = s.filter("start").select(*RUN, "event_id", "timestamp_ns", "node", F.when(F.col("nxt.node") != F.col("node"), F.col("nxt")).alias("change"))
    run_end = scan(starts.select("*", F.lit(1).alias("one")), RUN, "timestamp_ns", {"change_after": ("nearest", F.col("change"))}, inclusive=True, direction="after").select(*RUN, "event_id", "change_after")
    ends = s.filter("NOT start AND nxt IS NOT NULL").select(*RUN, F.col("event_id").alias("end_id"), "node", "nxt", F.col("nxt.event_id").alias("event_id"))
    j = ends.join(run_end, [*RUN, "event_id"], "left")
    hit = F.when(F.col("nxt.node") != F.col("node"), F.col("nxt")).otherwise(F.col("change_after"))
    return j.withColumn("hit", hit).filter("hit IS NOT NULL").select(*RUN, "end_id", F.col("node").alias("source"), F.col("hit.event_id").alias("start_id"), F.col("hit.node").alias("target"))


def next_prompts(events: DataFrame, asks: DataFrame) -> DataFrame:
    """asks(repo_id, run_id, ask_id, node, timestamp_ns): the first model call of the node after each time."""
    c = events.filter(F.col("event_type") == "llm.call_start").select(*RUN, F.col(NID).alias("node"), "timestamp_ns", F.lit(None).cast("string").alias("ask_id"), F.struct("event_id", F.coalesce("payload.last_user_message_preview", F.lit("")).alias("prompt")).alias("call"))
    a = asks.select(*RUN, "node", "timestamp_ns", "ask_id", F.lit(None).cast(c.schema["call"].dataType).alias("call"))
    s = scan(c.unionByName(a), [*RUN, "node"], "timestamp_ns", {"nxt": ("nearest", F.col("call"))}, direction="after")
    return s.filter("ask_id IS NOT NULL").select(*RUN, "ask_id", "node", F.col("nxt.event_id").alias("call_id"), F.col("nxt.prompt").alias("prompt"))


def delegation_pairs(events: DataFrame, least: int = 20) -> DataFrame:
    """What a node handed over and what the receiver was asked next, for every delegation of a run; whole texts.

    kind, source_event, target_event, source, target, source_role, target_role, output, input, their lengths, pair_key
    and first_of_pair. Explicit delegations take the initiator's output; between a task end and the next start of
    another node a delegation is inferred unless the run has an explicit one of the same two nodes. The input is the
    receiver's first model call strictly later (of equally late ones the smallest event_id); a receiver without a name
    takes any node's. Pairs with a text below `least` characters are left out. Pairs of the same texts share pair_key, and one
    of them (the first by repo_id, run_id, target_event) is marked, so a judge need not see the others. Events are
    read once; what follows works on a narrow table.
    """
    types = ["delegation.initiated", "delegation.completed", "agent.task_start", "agent.task_end", "llm.call_start"]
    fields = [F.col(f"payload.{f}") for f in ("delegation_id", "output_preview", "last_user_message_preview")]
    e = land(events.filter(F.col("event_type").isin(types)).select(*RUN, "event_id", "timestamp_ns", "event_type", "source_node", "target_node", F.struct(*fields).alias("payload")), "delegation_events")
    node = lambda c: F.coalesce(F.col(c), F.lit(""))
    given = explicit_delegations(e).select(*RUN, F.lit("explicit").alias("kind"), F.col("initiated_id").alias("source_event"), F.col("completed_id").alias("target_event"), node("source").alias("source"), node("target").alias("target"))
    guess = inferred_delegations(e).select(*RUN, F.lit("inferred").alias("kind"), F.col("end_id").alias("source_event"), F.col("start_id").alias("target_event"), "source", "target")
    guess = guess.join(given.select(*RUN, "source", "target").distinct(), [*RUN, "source", "target"], "left_anti")
    both = given.unionByName(guess.select(*given.columns))
    text = e.select(*RUN, F.col("event_id").alias("source_event"), "timestamp_ns", F.coalesce("payload.output_preview", F.lit("")).alias("output"))
    both = land(both.join(text, [*RUN, "source_event"]).filter(F.length("output") >= least), "handed_over")

    # Merged pass: calls and questions of a (run, node) in one order, each question takes the nearest call after it.
    calls = e.filter("event_type = 'llm.call_start'").select(*RUN, F.explode(F.array_distinct(F.array(node(NID), F.lit("")))).alias("node"), "timestamp_ns", F.struct("event_id", F.coalesce("payload.last_user_message_preview", F.lit("")).alias("text")).alias("call"))
    calls = calls.groupBy(*RUN, "node", "timestamp_ns").agg(F.min("call").alias("call"))
    asks = both.select(*RUN, F.col("target").alias("node"), "timestamp_ns", F.struct(*[c for c in both.columns if c not in (*RUN, "timestamp_ns")]).alias("pair"))
    merged = asks.withColumn("call", F.lit(None).cast(calls.schema["call"].dataType)).unionByName(calls.withColumn("pair", F.lit(None).cast(asks.schema["pair"].dataType)))
    met = scan(merged, [*RUN, "node"], "timestamp_ns", {"next_call": ("nearest", F.col("call"))}, direction="after")
    role = lambda c: F.coalesce(nz(F.element_at(F.split(c, ":"), -1)), F.lit("agent"))
    pairs = met.filter("pair IS NOT NULL AND next_call IS NOT NULL").select(*RUN, "pair.*", F.col("next_call.text").alias("input")).filter(F.length("input") >= least)
    key = F.sha2(F.concat(F.length("output").cast("string"), F.lit(":"), "output", "input"), 256)
    pairs = pairs.withColumns({"source_role": role("source"), "target_role": role("target"), "output_length": F.length("output"), "input_length": F.length("input"), "pair_key": key})
    pairs = land(pairs, "delegation_pairs")
    here = F.struct(*RUN, "target_event", "source_event")
    first = pairs.groupBy("pair_key").agg(F.min(here).alias("first"))
    return pairs.join(first, "pair_key").withColumn("first_of_pair", F.col("first") == here).drop("first")


def node_outputs(events: DataFrame) -> DataFrame:
    """The last output preview of each node and run."""
    o = events.filter(F.col("event_type").isin("agent.task_end", "llm.call_end") & nz(F.col("payload.output_preview")).isNotNull() & nz(F.col(NID)).isNotNull())
    return o.groupBy(*RUN, F.col(NID).alias("node")).agg(F.max_by("payload.output_preview", F.struct("timestamp_ns", "event_id")).alias("preview"))


def delegation_chain(events: DataFrame) -> DataFrame:
    """First task end with a preview per node, in time order (one row per link)."""
    o = events.filter((F.col("event_type") == "agent.task_end") & nz(F.col("payload.output_preview")).isNotNull() & nz(F.col(NID)).isNotNull())
    f = o.groupBy(*RUN, F.col(NID).alias("node")).agg(F.min(F.struct("timestamp_ns", "event_id", F.col("payload.output_preview").alias("preview"))).alias("f")).select(*RUN, "node", "f.timestamp_ns", "f.event_id", "f.preview")
    p = scan(f, RUN, "timestamp_ns", {"position": ("sum", F.lit(1))}, tie=["event_id"])
    n = f.groupBy(*RUN).agg(F.count(F.lit(1)).alias("links"))
    return p.join(n, RUN).filter("links >= 2").select(*RUN, "position", "links", "node", F.col("preview").alias("output"))


def chain_text(chain: DataFrame) -> DataFrame:
    """The judged text of each chain. A chain has one link per node, so its size is the graph's."""
    role = F.element_at(F.split("node", ":"), -1)
    where = F.when(F.col("position") == 0, "FIRST").when(F.col("position") == F.col("links") - 1, "LAST").otherwise(F.format_string("MIDDLE (%d/%d)", (F.col("position") + 1).cast("long"), F.col("links")))
    part = F.format_string("AGENT %s (%s) output:\n%s", where, role, "output")
    return chain.groupBy(*RUN).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"), F.max("links").alias("links")).filter(F.length("text") >= 50)


def leading_runs(events: DataFrame, k: int) -> DataFrame:
    """(repo_id, run_id, rank): the first k runs of each repository; the rank limit runs before the shuffle."""
    r = events.select(*RUN).distinct().withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy("run_id")))
    return r.filter(F.col("rank") <= k)


def output_pairs(events: DataFrame, from_rank: int = 4) -> DataFrame:
    """Outputs of the first run against the repeats per node, whole, at least 20 characters.

    Repeats are all runs after the first `from_rank` - 1.
    """
    lead = leading_runs(events, from_rank - 1)
    o = node_outputs(events).filter(F.length("preview") >= 20)
    a = o.join(lead.filter("rank = 1"), RUN, "left_semi").select("repo_id", "node", F.col("preview").alias("first_output"))
    b = o.join(lead, RUN, "left_anti").select("repo_id", "node", "run_id", F.col("preview").alias("other_output"))
    return b.join(a, ["repo_id", "node"])


def escalation_calls(events: DataFrame, k: int = 5) -> DataFrame:
    """The first five calls of each node and run, with a flag for an earlier error of the node."""
    et = F.col("event_type")
    e = events.filter((et.startswith("error.") | (et == "llm.call_end")) & nz(F.col(NID)).isNotNull()).select(*RUN, F.col(NID).alias("node"), "event_id", "timestamp_ns", (et == "llm.call_end").alias("is_call"), F.coalesce("payload.output_preview", F.lit("")).alias("preview"))
    err = e.filter("NOT is_call").groupBy(*RUN, "node").agg(F.min("timestamp_ns").alias("first_error"))
    n = e.filter("is_call").groupBy(*RUN, "node").agg(F.count(F.lit(1)).alias("calls")).filter("calls >= 2")
    c = scan(e.filter("is_call"), [*RUN, "node"], "timestamp_ns", {"position": ("sum", F.lit(1))}, tie=["event_id"]).filter(F.col("position") < k)
    return c.join(n, [*RUN, "node"]).join(err, [*RUN, "node"], "left").select(*RUN, "node", "position", "calls", F.coalesce(F.col("first_error") < F.col("timestamp_ns"), F.lit(False)).alias("after_error"), "preview")


# ---- judged answers ------------------------------------------------------------
ANSWERS = {  # pass: schema of the answer and the default of each field
    1: ("hedging_preserved boolean, source_attribution_preserved boolean, scope_preserved boolean, factual_additions_detected boolean, format_transformation_loss boolean, role_boundary_respected boolean, mast_failure_mode string, uncertainty_transfer string", {"mast_failure_mode": "unknown", "uncertainty_transfer": "unknown"}),
    2: ("factual_agreement boolean, structural_agreement boolean, confidence_direction string, semantic_overlap_estimate double, novel_claims_in_other bigint, dropped_claims_from_run1 bigint", {"confidence_direction": "unclear", "semantic_overlap_estimate": 0.5, "novel_claims_in_other": 0, "dropped_claims_from_run1": 0}),
    3: ("claim_identified string, confidence_at_origin string, confidence_at_terminus string, elevation_boundary string, information_accretion boolean, accretion_boundary string, chain_fidelity double", {"claim_identified": "none", "confidence_at_origin": "unknown", "confidence_at_terminus": "unknown", "elevation_boundary": "none", "information_accretion": False, "accretion_boundary": "none", "chain_fidelity": 0.5}),
    4: ("confidence_trajectory string, compensatory_assertion boolean, tool_failure_acknowledged boolean, fabrication_risk string", {"confidence_trajectory": "stable", "compensatory_assertion": False, "tool_failure_acknowledged": True, "fabrication_risk": "none"}),
}


def answers(df: DataFrame, raw: str, number: int) -> DataFrame:
    """Parse judged answers of one pass: known fields only, defaults where missing."""
    schema, defaults = ANSWERS[number]
    d = df.withColumn("_a", F.from_json(raw, schema))
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return d.select(*[c for c in df.columns if c != raw], *[F.coalesce(F.col(f"_a.{n}"), F.lit(defaults[n])).alias(n) if n in defaults else F.col(f"_a.{n}").alias(n) for n in names])


def fidelity_score() -> Column:
    yes = lambda *c: sum((F.coalesce(F.col(x), F.lit(False)).cast("int") for x in c), F.lit(0))
    s = yes("hedging_preserved", "source_attribution_preserved", "scope_preserved", "role_boundary_respected") / 4 - yes("factual_additions_detected", "format_transformation_loss") * 0.15
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def stability_score() -> Column:
    b = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    return (b("factual_agreement") + b("structural_agreement") + F.col("semantic_overlap_estimate")) / 3


def aggregate_scores(p1: DataFrame, p3: DataFrame, p4: DataFrame, by: list[str]) -> DataFrame:
    """Rates of the passes per group and the overall exposure estimate."""
    share = lambda c: count_if(c) / F.count(F.lit(1))
    h, f = F.coalesce("hedging_preserved", F.lit(False)), F.coalesce("factual_additions_detected", F.lit(False))
    a = p1.groupBy(*by).agg(share(h).alias("hedging_preservation_rate"), share(~h & f).alias("trust_elevation_rate"))
    b = p3.groupBy(*by).agg(F.avg("chain_fidelity").alias("mean_chain_fidelity"), share(F.col("information_accretion")).alias("information_accretion_rate"), share((F.col("confidence_at_origin") == "hedged") & (F.col("confidence_at_terminus") == "asserted")).alias("elevation_rate"))
    c = p4.groupBy(*by).agg(share(F.col("confidence_trajectory") == "escalating").alias("confidence_escalation_rate"), share(F.col("fabrication_risk").isin("high", "medium")).alias("fabrication_risk_rate"), share(F.col("compensatory_assertion")).alias("compensatory_assertion_rate"))
    j = a.join(b, by, "full_outer").join(c, by, "full_outer")
    oer = 1 - (1 - F.coalesce("trust_elevation_rate", F.lit(0.0))) * F.coalesce("mean_chain_fidelity", F.lit(1.0)) * (1 - F.coalesce("fabrication_risk_rate", F.lit(0.0)))
    return j.withColumn("mean_delegation_fidelity", 1 - F.col("trust_elevation_rate")).withColumn("oer_estimate", oer)


def edge_semantics(p1: DataFrame) -> DataFrame:
    """Per edge: preservation and addition rates and the most frequent failure mode."""
    modes = p1.groupBy("repo_id", "source", "target", "mast_failure_mode").agg(F.count(F.lit(1)).alias("n"))
    top = modes.groupBy("repo_id", "source", "target").agg(F.max_by("mast_failure_mode", F.struct("n", "mast_failure_mode")).alias("dominant_mast_failure"))
    a = p1.groupBy("repo_id", "source", "target").agg(F.avg(F.coalesce("hedging_preserved", F.lit(False)).cast("int")).alias("hedging_preservation_rate"), F.avg(F.coalesce("factual_additions_detected", F.lit(False)).cast("int")).alias("factual_addition_rate"),
                                                     F.avg((~F.coalesce("hedging_preserved", F.lit(False)) & F.coalesce("factual_additions_detected", F.lit(False))).cast("int")).alias("drift_rate"), F.count(F.lit(1)).alias("evaluation_count"))
    return a.join(top, ["repo_id", "source", "target"])


# ---- findings of the passes -----------------------------------------------------------
# fixed values: finding -> (name, severity)
SEMANTIC_FINDINGS = {
    "STRAT-SD-001": ("Semantic Drift at Trust Boundary", "high"), "STRAT-HC-001": ("Hallucination Propagation Chain", "critical"), "STRAT-CE-001": ("Confidence Escalation Under Failure", "high"),
    "STRAT-SC-001": ("Semantic Inconsistency Across Runs", "medium"), "STRAT-TV-001": ("Topological Vulnerability Concentration", "high"),
}


def drifting_edges(fidelity: DataFrame, above: float = 0.5, least: int = 2) -> DataFrame:
    """(repo_id, source, target, drift_rate, mode, measurements): edges whose handovers mostly lose hedging and gain facts.

    fidelity(repo_id, source, target, ord, hedging_preserved, factual_additions, mode, failed); answers that failed do not
    count. `mode` is the most frequent failure mode, the one seen first (by ord, then name) on a tie.
    """
    ok = fidelity.filter(~F.coalesce("failed", F.lit(False)))
    drift = ~F.coalesce("hedging_preserved", F.lit(False)) & F.coalesce("factual_additions", F.lit(False))
    key = ["repo_id", "source", "target"]
    modes = ok.groupBy(*key, F.coalesce("mode", F.lit("unknown")).alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("since"), count_if(drift).alias("drifts"))
    best = F.min_by("mode", F.struct((-F.col("n")).alias("n"), "since", "mode"))
    per = modes.groupBy(*key).agg(F.sum("n").alias("measurements"), F.sum("drifts").alias("drifts"), best.alias("mode"))
    return per.withColumn("drift_rate", F.col("drifts") / F.col("measurements")).filter((F.col("measurements") >= least) & (F.col("drift_rate") > above)).select(*key, F.round("drift_rate", 2).alias("drift_rate"), "mode", "measurements")


def semantic_findings(fidelity: DataFrame, chains: DataFrame, escalations: DataFrame, stability: DataFrame, vulnerability: DataFrame) -> DataFrame:
    """(repo_id, finding_id, finding_name, severity, subject, measure): what the five passes found, one row a place.

    subject is the edge ('source->target'), the run or the node. chains(repo_id, run_id, information_accretion,
    chain_fidelity); escalations(repo_id, run_id, node, compensatory_assertion, fabrication_risk, had_preceding_errors,
    call_count); stability(repo_id, node, stability_score); vulnerability(repo_id, node, vulnerability_score,
    defense_count). Missing scores count as harmless.
    """
    one = F.lit(1.0)
    found = {
        "STRAT-SD-001": drifting_edges(fidelity).select("repo_id", F.concat("source", F.lit("->"), "target").alias("subject"), F.col("drift_rate").alias("measure")),
        "STRAT-HC-001": chains.filter(F.coalesce("information_accretion", F.lit(False)) & (F.coalesce("chain_fidelity", one) < 0.5)).select("repo_id", F.col("run_id").alias("subject"), F.col("chain_fidelity").alias("measure")),
        "STRAT-CE-001": escalations.filter(F.coalesce("compensatory_assertion", F.lit(False)) & (F.col("fabrication_risk") == "high") & F.coalesce("had_preceding_errors", F.lit(False))).select("repo_id", F.concat_ws("/", "run_id", "node").alias("subject"), F.col("call_count").cast("double").alias("measure")),
        "STRAT-SC-001": stability.filter(F.coalesce("stability_score", one) < 0.5).select("repo_id", F.col("node").alias("subject"), F.col("stability_score").alias("measure")),
        "STRAT-TV-001": vulnerability.filter((F.coalesce("vulnerability_score", F.lit(0.0)) > 0.7) & (F.coalesce("defense_count", F.lit(0)) == 0)).select("repo_id", F.col("node").alias("subject"), F.col("vulnerability_score").alias("measure")),
    }
    out = None
    for finding, rows in found.items():
        name, severity = SEMANTIC_FINDINGS[finding]
        part = rows.select("repo_id", F.lit(finding).alias("finding_id"), F.lit(name).alias("finding_name"), F.lit(severity).alias("severity"), "subject", F.col("measure").cast("double").alias("measure"))
        out = part if out is None else out.unionByName(part)
    return out


# fixed values: fabrication risks from harmless to grave
RISKS = ["none", "low", "medium", "high"]


def node_semantics(nodes: DataFrame, stability: DataFrame, vulnerability: DataFrame, escalations: DataFrame) -> DataFrame:
    """`nodes`(repo_id, node) with stability_score, vulnerability_score, escalation_rate, max_fabrication_risk, compensatory_assertion_observed.

    Nodes without an answer keep nulls. Unknown risks count as none; of repeated stability or vulnerability rows the
    greatest score counts.
    """
    key = ["repo_id", "node"]
    rank = F.greatest(F.array_position(F.array(*map(F.lit, RISKS)), F.coalesce("fabrication_risk", F.lit("none"))) - 1, F.lit(0))
    esc = escalations.groupBy(*key).agg(
        F.avg((F.coalesce("confidence_trajectory", F.lit("")) == "escalating").cast("double")).alias("escalation_rate"), F.get(F.array(*map(F.lit, RISKS)), F.max(rank).cast("int")).alias("max_fabrication_risk"),
        F.max(F.coalesce("compensatory_assertion", F.lit(False))).alias("compensatory_assertion_observed"))
    out = nodes.select(*key)
    for part in (stability.groupBy(*key).agg(F.max("stability_score").alias("stability_score")), vulnerability.groupBy(*key).agg(F.max("vulnerability_score").alias("vulnerability_score")), esc):
        out = out.join(part, key, "left")
    return out


def boundary_patterns(patterns: DataFrame) -> DataFrame:
    """Defensive patterns near an agent boundary, which stand for every edge of their repository."""
    return patterns.filter(F.coalesce("near_boundary", F.lit(False)))
