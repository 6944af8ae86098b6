"""The cross-repository knowledge base: patterns, preconditions, fragility, interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from spoor.constants import PRECONDITIONS
from spoor.functions.pvalues import pearson_p
from spoor.functions.stats import bool_or, count_if, level, ratio, wilson
from spoor.operators import graph as G
from spoor.sources.inline import values

MIN_CO_OCCURRENCE = 5


def repo_behavior(behavior: DataFrame) -> DataFrame:
    """Node behavior rolled up to the repository: failed at all, error totals, sums for later means."""
    c = F.col
    return behavior.groupBy("repo_id").agg(
        bool_or(c("errors_occurred") > 0).alias("failed"),
        bool_or((c("failure_rate") > 0) | ((c("errors_occurred") > 0) & (F.size("observed_error_handling") > 0))).alias("had_runtime_failures"),
        F.sum("errors_occurred").alias("total_errors"), F.sum("propagated_downstream").alias("cascade_failures"),
        F.coalesce(F.avg(F.when(c("propagation_rate") > 0, c("propagation_rate"))), F.lit(0.0)).alias("avg_propagation_rate"), F.count(F.lit(1)).alias("node_count"),
        F.avg("failure_rate").alias("avg_failure_rate"), F.avg("propagation_rate").alias("mean_propagation"), F.avg("p50").alias("avg_latency_p50"), F.coalesce(F.avg("decision_entropy"), F.lit(0.0)).alias("avg_decision_entropy"),
        F.sum(F.when(c("failure_rate") > 0, c("failure_rate"))).alias("rate_sum"), count_if(c("failure_rate") > 0).alias("rate_n"), F.sum(F.when(c("p50") > 0, c("p50"))).alias("p50_sum"), count_if(c("p50") > 0).alias("p50_n"))


def motif_distribution(motif_repos: DataFrame, repos: DataFrame, by: list[str]) -> DataFrame:
    """Failure rate with its Wilson interval, mean error rate and mean latency per group of repositories."""
    a = motif_repos.join(repos, "repo_id").groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_size"), count_if(F.col("failed")).alias("repos_with_failure"), F.sum("rate_sum").alias("rs"), F.sum("rate_n").alias("rn"), F.sum("p50_sum").alias("ps"), F.sum("p50_n").alias("pn"))
    low, high = wilson(F.col("repos_with_failure"), F.col("sample_size"))
    return a.select(*by, "sample_size", "repos_with_failure", (F.col("repos_with_failure") / F.col("sample_size")).alias("failure_rate"), low.alias("ci_low"), high.alias("ci_high"),
                    F.coalesce(ratio(F.col("rs"), F.col("rn")), F.lit(0.0)).alias("avg_error_rate"), F.coalesce(ratio(F.col("ps"), F.col("pn")), F.lit(0.0)).alias("avg_latency_p50_ms"))


def failure_mode_counts(motif_repos: DataFrame, behavior: DataFrame) -> DataFrame:
    """(motif, mode, n): error-handling modes seen on nodes of the motif's repositories."""
    modes = behavior.filter("errors_occurred > 0").select("repo_id", F.explode("observed_error_handling").alias("mode")).groupBy("repo_id", "mode").agg(F.count(F.lit(1)).alias("n"))
    return motif_repos.select("repo_id", "motif").distinct().join(modes, "repo_id").groupBy("motif", "mode").agg(F.sum("n").alias("n"))


def motif_fragility(motif_nodes: DataFrame, behavior: DataFrame) -> DataFrame:
    j = motif_nodes.join(behavior.select("repo_id", "node_id", "tool_call_failure_rate", "quality_dependent"), ["repo_id", "node_id"])
    return j.groupBy("motif").agg(F.avg("tool_call_failure_rate").alias("avg_tool_call_failure_rate"), F.avg(F.col("quality_dependent").cast("int")).alias("quality_dependent_rate"), F.count(F.lit(1)).alias("sample_count"))


def patterns(motif_nodes: DataFrame, behavior: DataFrame, repos: DataFrame, *, per_instance: bool = False) -> DataFrame:
    """One row per motif: prevalence, behavior, fragility, risk. `per_instance` counts a repository once per motif instance."""
    owners = motif_nodes.select("repo_id", "motif", "instance").distinct() if per_instance else motif_nodes.select("repo_id", "motif").distinct()
    dist = motif_distribution(owners, repos, ["motif"])
    prev = motif_nodes.select("repo_id", "motif").distinct().groupBy("motif").agg(F.count(F.lit(1)).alias("repos_count"))
    total = repos.agg(F.count(F.lit(1)).alias("total_repos"))
    out = dist.join(prev, "motif").join(motif_fragility(motif_nodes, behavior), "motif", "left").fillna(0).join(F.broadcast(total))  # one row
    fr, tf, pv = F.col("failure_rate") * 0.5, F.col("avg_tool_call_failure_rate") * 0.3, F.least(F.col("repos_count"), F.lit(100)) / 100 * 0.2
    score = fr + tf + pv
    return out.withColumn("prevalence_rate", F.col("repos_count") / F.col("total_repos")).withColumn("risk_score", score).withColumn("risk_level", level(score, [(0.6, "high"), (0.3, "medium")], "low", strict=True)).withColumn(
        "pattern_id", F.concat(F.lit("pat_"), "motif"))


def novel_patterns(repos: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Repositories whose behavior lies more than two standard deviations from the corpus in some dimension."""
    dims = {"avg_failure_rate": "avg_failure_rate", "avg_propagation_rate": "mean_propagation", "avg_latency_p50": "avg_latency_p50", "avg_decision_entropy": "avg_decision_entropy"}
    stats = repos.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m_{d}") for d, c in dims.items()], *[F.stddev_pop(c).alias(f"_s_{d}") for d, c in dims.items()])
    z = repos.join(F.broadcast(stats)).filter("_n >= 3")  # stats is one row
    for d, c in dims.items():
        sd = F.when(F.col(f"_s_{d}") == 0, 1.0).otherwise(F.col(f"_s_{d}"))
        z = z.withColumn(f"z_{d}", (F.col(c) - F.col(f"_m_{d}")) / sd)
    zs = F.array(*[F.abs(f"z_{d}") for d in dims])
    z = z.withColumn("anomaly_score", F.array_max(zs)).filter(F.col("anomaly_score") > threshold)
    return z.select("repo_id", "anomaly_score", F.get(F.array(*[F.lit(d) for d in dims]), F.array_position(zs, F.col("anomaly_score")).cast("int") - 1).alias("most_anomalous_dimension"), *[f"z_{d}" for d in dims])


def framework_comparison(motif_nodes: DataFrame, frameworks: DataFrame, repos: DataFrame) -> DataFrame:
    """Distribution per motif and framework, for motifs seen in two or more frameworks."""
    owners = motif_nodes.select("repo_id", "motif").distinct().join(frameworks, "repo_id")
    d = motif_distribution(owners, repos, ["motif", "framework"])
    several = d.groupBy("motif").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("motif")
    return d.join(several, "motif", "left_semi")


def manifestations(pre: DataFrame, repos: DataFrame) -> DataFrame:
    """Per known precondition: probability of failure, interval, severity, and risk against the rest.

    The control group is the total minus the group itself, so it needs no second pass.
    """
    known = values(pre.sparkSession, [(p,) for p in PRECONDITIONS], ["precondition"])
    has = pre.select("repo_id", "precondition").distinct().join(repos, "repo_id").groupBy("precondition").agg(
        F.count(F.lit(1)).alias("sample_size"), count_if(F.col("had_runtime_failures")).alias("manifested"),
        F.avg(F.when(F.col("had_runtime_failures") & (F.col("total_errors") > 0), F.col("total_errors"))).alias("avg_errors"))
    all_ = repos.agg(F.count(F.lit(1)).alias("_n"), count_if(F.col("had_runtime_failures")).alias("_f"))
    out = F.broadcast(known).join(has, "precondition", "left").fillna(0, ["sample_size", "manifested"]).join(F.broadcast(all_))  # one row
    low, high = wilson(F.col("manifested"), F.col("sample_size"))
    some = F.col("sample_size") > 0
    p = F.when(some, F.col("manifested") / F.col("sample_size"))
    sev = F.coalesce("avg_errors", F.lit(0.0))
    control = ratio(F.col("_f") - F.col("manifested"), F.col("_n") - F.col("sample_size"))
    return out.select("precondition", "sample_size", "manifested", p.alias("probability"), F.when(some, low).alias("ci_low"), F.when(some, high).alias("ci_high"), F.when(some, sev).alias("avg_errors"),
                      F.when(some, level(sev, [(10, "high"), (3, "medium"), (0, "low")], "none", strict=True)).alias("severity_label"),
                      F.when(some, control).alias("control_failure_rate"), F.when(some, p / F.greatest(control, F.lit(0.01))).alias("relative_risk"))


def structure_metrics(nodes: DataFrame, edges: DataFrame, repos: DataFrame) -> DataFrame:
    """Structural and run-time figures per repository for the correlations."""
    n = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges"), count_if(F.col("edge_type").isin("filtered_by", "gated_by")).alias("guards"))
    depth = delegation_depth(edges)
    out = n.join(e, "repo_id", "left").join(depth, "repo_id", "left").join(repos, "repo_id").fillna(0, ["edges", "guards", "delegation_depth"])
    d = lambda c: c.cast("double")
    return out.select("repo_id", d(F.col("nodes")).alias("node_count"), d(F.col("edges")).alias("edge_count"), d(F.col("delegation_depth")).alias("delegation_depth"),
                      (F.col("edges") / F.greatest("nodes", F.lit(1))).alias("betweenness_proxy"), (F.col("guards") / F.greatest("nodes", F.lit(1))).alias("control_coverage"),
                      d(F.col("total_errors")).alias("total_errors"), d(F.col("cascade_failures")).alias("cascade_failures"), "avg_propagation_rate")


def delegation_roots(edges: DataFrame) -> DataFrame:
    """(repo_id, node): delegating nodes nobody delegates to; all delegating nodes if there are none."""
    d = edges.filter("edge_type = 'delegates_to' AND source <> '' AND target <> ''")
    src = d.select("repo_id", F.col("source").alias("node")).distinct()
    true = src.join(d.select("repo_id", F.col("target").alias("node")), ["repo_id", "node"], "left_anti")
    return true.unionByName(src.join(true.select("repo_id").distinct(), "repo_id", "left_anti"))


def delegation_depth(edges: DataFrame) -> DataFrame:
    """(repo_id, delegation_depth): nodes on the longest simple delegation path from the roots."""
    return G.longest_path(edges, delegation_roots(edges), types=["delegates_to"]).withColumnRenamed("nodes", "delegation_depth")


CORRELATIONS = [("betweenness_proxy", "cascade_failures"), ("control_coverage", "avg_propagation_rate"), ("delegation_depth", "total_errors"), ("node_count", "total_errors"), ("edge_count", "cascade_failures")]


def correlations(metrics: DataFrame) -> DataFrame:
    """Pearson r and p per metric pair with a verbal strength; null where a metric does not vary."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for x, y in CORRELATIONS:
        aggs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"{x}_vs_{y}"))
    one = metrics.agg(*aggs).filter("n >= 3")
    long = one.select("n", F.expr(f"stack({len(CORRELATIONS)}, {', '.join(f'{x + chr(95) + chr(118) + chr(115) + chr(95) + y!r}, {x}_vs_{y}' for x, y in CORRELATIONS)}) AS (pair, correlation)"))
    r = F.abs("correlation")
    strength = F.when(r > 0.7, "Strong").when(r > 0.4, "Moderate").when(r > 0.2, "Weak").otherwise("Negligible")
    out = long.withColumn("p_value", F.when(F.col("correlation").isNotNull(), pearson_p(F.col("correlation"), F.col("n"))))
    text = F.format_string("%s %s correlation (%s at p<0.05).", strength, F.when(F.col("correlation") > 0, "positive").otherwise("negative"), F.when(F.col("p_value") < 0.05, "significant").otherwise("not significant"))
    return out.select("pair", F.col("n").alias("sample_size"), "correlation", "p_value", F.when(F.col("correlation").isNull(), "Insufficient variance for correlation.").otherwise(text).alias("interpretation"))


def severity_score(avg_errors, cascade_depth, nodes_affected, total_nodes):
    """0-100 from error volume, cascade depth and blast radius."""
    return F.least(avg_errors / 50, F.lit(1.0)) * 30 + F.least(cascade_depth / 5, F.lit(1.0)) * 40 + ratio(nodes_affected, total_nodes) * 30


def structural_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """isolated / hub / leaf / chain / connector per node from its degrees."""
    ends = edges.select("repo_id", F.explode(F.array(
        F.struct(F.col("source").alias("node_id"), F.lit("o").alias("side"), F.col("edge_type").alias("t")), F.struct(F.col("target").alias("node_id"), F.lit("i").alias("side"), F.col("edge_type").alias("t")))).alias("x")).select("repo_id", "x.*")
    d = F.col("t") == "delegates_to"
    deg = ends.groupBy("repo_id", "node_id").agg(count_if(F.col("side") == "o").alias("out"), count_if(F.col("side") == "i").alias("in"), count_if((F.col("side") == "o") & d).alias("dout"), count_if((F.col("side") == "i") & d).alias("din"))
    j = nodes.select("repo_id", "node_id").join(deg, ["repo_id", "node_id"], "left").fillna(0)
    role = (F.when(F.col("out") + F.col("in") == 0, "isolated_node").when(F.col("out") >= 3, "hub_node").when((F.col("dout") == 0) & (F.col("in") > 0), "leaf_node")
            .when((F.col("din") == 1) & (F.col("dout") == 1), "chain_node").otherwise("connector_node"))
    return j.select("repo_id", "node_id", role.alias("role"))


def sensitivity():
    """0-1 model sensitivity of a node from its behavior columns."""
    ent = F.when(F.coalesce("decisions_made", F.lit(0)) > 0, F.least(F.coalesce("decision_entropy", F.lit(0.0)) / 4, F.lit(1.0))).otherwise(0.0)
    s = F.least("tool_call_failure_rate", F.lit(1.0)) * 0.4 + F.col("quality_dependent").cast("int") * 0.3 + F.least(F.col("retry_activations") / 10, F.lit(1.0)) * 0.2 + ent * 0.1
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))


def fragile_nodes(behavior: DataFrame, roles: DataFrame) -> DataFrame:
    active = (F.col("tool_call_failures") > 0) | F.col("quality_dependent") | (F.col("activation_count") > 0)
    return behavior.filter(active).join(roles, ["repo_id", "node_id"]).withColumn("sensitivity_score", sensitivity())


def fragility_map(fragile: DataFrame) -> DataFrame:
    return fragile.groupBy(F.col("role").alias("structural_position")).agg(
        F.avg("tool_call_failure_rate").alias("avg_tool_call_failure_rate"), F.max("tool_call_failure_rate").alias("max_tool_call_failure_rate"), F.count_distinct("repo_id").alias("affected_repos_count"), F.count(F.lit(1)).alias("total_nodes_analyzed"),
        F.avg(F.col("quality_dependent").cast("int")).alias("quality_dependent_rate"), F.avg("retry_activations").alias("avg_retry_activations"), F.avg("sensitivity_score").alias("sensitivity_score"), F.max("sensitivity_score").alias("max_sensitivity_score"))


def top_fragile(fragile: DataFrame, k: int = 5) -> DataFrame:
    """The k most sensitive nodes of each role (a ranked report)."""
    w = W.partitionBy("role").orderBy(F.desc(F.round("sensitivity_score", 4)), "repo_id", "node_id")
    return fragile.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("role", "rank", "repo_id", "node_id", "sensitivity_score")


def interactions(pre: DataFrame, repos: DataFrame) -> DataFrame:
    """Failure rates of every precondition pair: both, one only, neither; effect against independence.

    Repositories collapse to distinct precondition sets first; only those sets, with their
    counts, are paired (at most 34 known ids each), and the other cells follow from margins.
    """
    per = pre.select("repo_id", "precondition").distinct().groupBy("repo_id").agg(F.sort_array(F.collect_set("precondition")).alias("pcs"))
    sets = repos.join(per, "repo_id", "left").groupBy("pcs").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("failed")).alias("f"))
    single = sets.select("n", "f", F.explode("pcs").alias("p")).groupBy("p").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    pairs = sets.select("n", "f", "pcs", F.posexplode("pcs").alias("i", "a")).select("n", "f", "a", F.explode(F.slice("pcs", F.col("i") + 2, F.size("pcs"))).alias("b")).groupBy("a", "b").agg(F.sum("n").alias("nb"), F.sum("f").alias("fb"))
    s = F.broadcast(single)  # at most one row per known precondition
    grid = s.select(F.col("p").alias("a"), F.col("n").alias("na"), F.col("f").alias("fa")).join(s.select(F.col("p").alias("b"), F.col("n").alias("nbb"), F.col("f").alias("fbb")), F.col("a") < F.col("b"))
    g = grid.join(pairs, ["a", "b"], "left").fillna(0).join(F.broadcast(repos.agg(F.count(F.lit(1)).alias("t"), count_if(F.col("failed")).alias("tf"))))
    both, ao, bo = F.col("nb"), F.col("na") - F.col("nb"), F.col("nbb") - F.col("nb")
    no = F.col("t") - F.col("na") - F.col("nbb") + F.col("nb")
    fb, fao, fbo = F.col("fb"), F.col("fa") - F.col("fb"), F.col("fbb") - F.col("fb")
    fno = F.col("tf") - F.col("fa") - F.col("fbb") + F.col("fb")
    rate = lambda f, n: F.when(n > 0, f / n).otherwise(0.0)
    g = g.select(F.col("a").alias("precondition_a"), F.col("b").alias("precondition_b"), both.alias("n_both"), ao.alias("n_a_only"), bo.alias("n_b_only"), no.alias("n_neither"),
                 rate(fb, both).alias("p_both"), rate(fao, ao).alias("p_a_only"), rate(fbo, bo).alias("p_b_only"), rate(fno, no).alias("p_neither"))
    expected = F.greatest(F.col("p_a_only") * F.col("p_b_only") / F.greatest("p_neither", F.lit(0.01)), F.lit(0.01))
    effect = F.when(F.col("n_both") >= MIN_CO_OCCURRENCE, F.col("p_both") / expected)
    return g.withColumn("interaction_effect", effect).withColumn("synergistic", F.col("interaction_effect") > 1.5)
