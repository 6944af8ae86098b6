"""Audit readiness and topology vulnerability."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spoor.constants import FINDING_REGULATIONS, REGULATION_REQUIREMENTS, REVIEW_WORDS
from spoor.functions.stats import bool_or, count_if, ratio
from spoor.functions.text import contains_any, nz
from spoor.sources.inline import values

RUN = ["repo_id", "run_id"]
NODE = ["repo_id", "node_id"]
PAIRS = {"task": ("agent.task_start", "agent.task_end"), "delegation": ("delegation.initiated", "delegation.completed"), "llm": ("llm.call_start", "llm.call_end")}


def start_end_keys(events: DataFrame) -> DataFrame:
    """(repo_id, run_id, kind, key, s, e): whether a key has a start and an end in its run."""
    et = F.col("event_type")
    kind = end = None
    for k, (a, b) in PAIRS.items():
        kind = F.when(et.isin(a, b), k) if kind is None else kind.when(et.isin(a, b), k)
    end = et.isin([b for _, b in PAIRS.values()])
    key = F.when(kind == "delegation", F.coalesce("payload.delegation_id", F.lit(""))).otherwise(F.coalesce("source_node.node_id", F.lit("")))
    return events.select(*RUN, kind.alias("kind"), key.alias("key"), end.alias("end")).filter("kind IS NOT NULL").groupBy(*RUN, "kind", "key").agg(bool_or(~F.col("end")).alias("s"), bool_or(F.col("end")).alias("e"))


def completeness(events: DataFrame) -> DataFrame:
    """Mean share of started keys that also end, per kind, over all runs; orphans on both sides."""
    per = start_end_keys(events).groupBy(*RUN, "kind").agg(ratio(count_if(F.col("s") & F.col("e")), count_if(F.col("s"))).alias("rate"), count_if(F.col("s") & ~F.col("e")).alias("os"), count_if(F.col("e") & ~F.col("s")).alias("oe"))
    runs = events.select(*RUN).distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    a = per.groupBy("repo_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rate"))), F.lit(0.0)).alias(k) for k in PAIRS], F.sum("os").alias("orphaned_starts"), F.sum("oe").alias("orphaned_ends"))
    j = runs.join(a, "repo_id", "left").fillna(0)
    j = j.select("repo_id", *[(F.col(k) / F.col("n")).alias(f"{k}_completion_rate") for k in PAIRS], "orphaned_starts", "orphaned_ends")
    return j.withColumn("overall_completeness", (F.col("task_completion_rate") + F.col("delegation_completion_rate") + F.col("llm_completion_rate")) / 3)


def separation_of_duties(nodes: DataFrame, edges: DataFrame, direct: DataFrame) -> DataFrame:
    """Self-review, unreviewed writers and single points of control; a score with capped penalties."""
    ends = edges.select("repo_id", F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.lit("o").alias("side")), F.struct(F.col("target").alias("node_id"), F.lit("i").alias("side")))).alias("x")).select("repo_id", "x.*")
    deg = ends.groupBy(*NODE).agg(count_if(F.col("side") == "o").alias("o"), count_if(F.col("side") == "i").alias("i"))
    reviewed = edges.filter(contains_any(F.lower("source"), REVIEW_WORDS)).select("repo_id", F.col("target").alias("node_id")).distinct().withColumn("reviewed", F.lit(True))
    writes = direct.select(*NODE, F.arrays_overlap("direct", F.array(F.lit("write_data"), F.lit("database"))).alias("w"))
    j = nodes.select(*NODE).join(deg, NODE, "left").join(writes, NODE, "left").join(reviewed, NODE, "left").fillna(0, ["o", "i"]).fillna(False, ["w", "reviewed"])
    a = j.groupBy("repo_id").agg(
        count_if(contains_any(F.lower("node_id"), REVIEW_WORDS) & (F.col("o") + F.col("i") > 0)).alias("self_review_nodes"), count_if(F.col("w") & (F.col("i") > 0) & ~F.col("reviewed")).alias("unreviewed_write_nodes"),
        count_if((F.col("i") == 0) & (F.col("o") > 0) & F.col("w")).alias("single_points_of_control"))
    score = F.lit(1.0) - F.when(F.col("self_review_nodes") > 0, 0.3).otherwise(0.0) - F.least(F.lit(0.4), F.col("unreviewed_write_nodes") * 0.1) - F.least(F.lit(0.4), F.col("single_points_of_control") * 0.2)
    return a.withColumn("separation_score", F.greatest(F.lit(0.0), score))


def traceability(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    out = et.isin("agent.task_end", "llm.call_end")
    return events.groupBy("repo_id").agg(count_if(et == "routing.decision").alias("routing_decisions_logged"), count_if(out & nz(F.col("payload.output_preview")).isNotNull()).alias("outputs_with_preview"),
                                         count_if(out | (et == "routing.decision")).alias("total_decision_points"), bool_or(et == "state.access").alias("has_state_access_logging")).withColumn("traceability_fraction", ratio(F.col("outputs_with_preview"), F.col("total_decision_points")))


def regulations(findings: DataFrame) -> DataFrame:
    """(repo_id, finding_id, frameworks, requirements): regulatory frameworks each finding touches."""
    m = values(findings.sparkSession, [(f, r, q) for f, rs in FINDING_REGULATIONS.items() for r in rs for q in REGULATION_REQUIREMENTS[r]], ["finding_id", "framework", "requirement"])
    return findings.join(F.broadcast(m), "finding_id", "left").groupBy("repo_id", "finding_id").agg(F.sort_array(F.collect_set("framework")).alias("frameworks"), F.sort_array(F.collect_set("requirement")).alias("requirements"))


def audit_readiness(events: DataFrame, nodes: DataFrame, edges: DataFrame, direct: DataFrame, findings: DataFrame) -> DataFrame:
    fw = regulations(findings).select("repo_id", F.explode("frameworks").alias("f")).distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("frameworks_at_risk"))
    j = completeness(events).select("repo_id", "overall_completeness").join(separation_of_duties(nodes, edges, direct).select("repo_id", "separation_score"), "repo_id").join(traceability(events).select("repo_id", "traceability_fraction"), "repo_id").join(fw, "repo_id", "left").fillna(0)
    score = F.col("overall_completeness") * 0.3 + F.col("separation_score") * 0.3 + F.col("traceability_fraction") * 0.25 + (1 - F.col("frameworks_at_risk") / len(REGULATION_REQUIREMENTS)) * 0.15
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return j.withColumn("audit_readiness_score", score).withColumn("finding_triggered", score < 0.5)


# ---- vulnerability ---------------------------------------------------------------
DEFENSES = {"has_timeout": "timeout_iteration_guards", "has_output_validation": "output_validation", "has_error_handling": "exception_handling_topology",
            "has_input_sanitization": "input_sanitization", "has_prompt_constraints": "prompt_constraints"}


def node_defenses(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """Defense flags per node: patterns near a boundary count for all nodes of the repository, others
    for nodes whose role occurs in the file path (joined on the role's first characters)."""
    from spoor.operators.resolve import grams

    role = F.lower(F.coalesce(F.get(F.split("node_id", ":"), 1), F.col("node_id")))
    n = nodes.select(*NODE, role.alias("role")).withColumn("g", F.left("role", F.lit(3)))
    near = patterns.filter("near_boundary").select("repo_id", "category").distinct()
    far = patterns.filter("NOT near_boundary").select("repo_id", "category", F.lower("path").alias("path")).distinct().withColumn("g", F.explode(grams(F.col("path"))))
    hit = n.join(near, "repo_id").select(*NODE, "category").unionByName(n.join(far, ["repo_id", "g"]).filter(F.contains("path", "role")).select(*NODE, "category")).distinct()
    f = hit.groupBy(*NODE).agg(*[bool_or(F.col("category") == c).alias(k) for k, c in DEFENSES.items()])
    out = nodes.select(*NODE).join(f, NODE, "left").fillna(False, list(DEFENSES))
    return out.withColumn("defense_count", sum((F.col(k).cast("int") for k in DEFENSES), F.lit(0)))


def vulnerability(nodes: DataFrame, edges: DataFrame, far: DataFrame, errors: DataFrame, defenses: DataFrame | None = None) -> DataFrame:
    """Vulnerability per node from its position, fan-in and reach, less what its defenses take off."""
    e = edges.select("repo_id", "source", "target").distinct()
    fo = e.groupBy("repo_id", F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("fan_out"))
    fi = e.groupBy("repo_id", F.col("target").alias("node_id")).agg(F.count(F.lit(1)).alias("fan_in"))
    reach = far.groupBy("repo_id", F.col("origin").alias("node_id")).agg(F.count(F.lit(1)).alias("reach"))
    total = nodes.groupBy("repo_id").agg(F.count_distinct("node_id").alias("total"))
    j = nodes.select(*NODE).distinct().join(total, "repo_id")
    for df in (fo, fi, reach, errors.select(*NODE, "error_count")):
        j = j.join(df, NODE, "left")
    j = j.fillna(0)
    i, o = F.col("fan_in"), F.col("fan_out")
    pos = F.when((i == 0) & (o > 0), "initial").when((i > 0) & (o == 0), "terminal").when((i > 0) & (o > 0), "intermediate").otherwise("isolated")
    j = j.withColumn("position_class", pos)
    t = F.col("total")
    bc = F.when((t > 2) & (F.col("position_class") == "intermediate"), F.least(F.lit(1.0), i * o / F.greatest(F.lit(1.0), (t - 1) * (t - 2) / 2))).otherwise(0.0)
    j = j.withColumn("betweenness", bc)
    raw = (F.lit(0.3) * F.when(F.col("position_class") == "terminal", 1.5).when(F.col("position_class") == "initial", 1.3).otherwise(1.0) * F.when(i > 1, 1 + 0.2 * i).otherwise(1.0)
           * F.when(F.col("reach") > 0, 1 + 0.15 * F.col("reach")).otherwise(1.0) * (1 + 0.3 * F.col("betweenness")))
    j = j.withColumn("raw_score", F.least(F.lit(1.0), raw))
    if defenses is not None:
        j = j.join(defenses, NODE, "left").fillna(False, list(DEFENSES)).fillna(0, ["defense_count"])
        cut_ = F.col("has_timeout").cast("int") * 0.1 + F.col("has_output_validation").cast("int") * 0.15 + F.col("has_error_handling").cast("int") * 0.1
    else:
        cut_ = F.lit(0.0)
    return j.withColumn("vulnerability_score", F.greatest(F.lit(0.0), F.col("raw_score") - cut_)).drop("total")


def all_scores(permission: DataFrame, privacy: DataFrame, cost: DataFrame, readiness: DataFrame) -> DataFrame:
    """One row per repository with its four scores; a score that could not be had is null and leaves the others alone."""
    parts = [permission.select("repo_id", "permission_risk_score"), privacy.select("repo_id", "privacy_exposure_score"), cost.select("repo_id", "cost_risk_score"), readiness.select("repo_id", "audit_readiness_score")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "repo_id", "full")
    return out
