"""Scoring and selection of a corpus: quotas, coverage, sampling, run planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spoor.functions.stats import count_if, ratio
from spoor.functions.text import nz
from spoor.session import cut

# fixed values: number of archetypes and framework lists
ARCHETYPES = 12
SUPPORTED = ["crewai", "langgraph", "autogen", "langchain", "custom"]
STANDARD = ["crewai", "langgraph", "autogen", "langchain"]
# fixed values: coverage targets of the discovery sample
FRAMEWORK_MIN = {"crewai": 100, "langgraph": 100, "autogen": 80, "langchain": 80, "llamaindex": 40, "smolagents": 30, "agno": 20, "generic": 50}
FRAMEWORK_BASE = {"crewai": 150, "langgraph": 150, "autogen": 100, "langchain": 100, "llamaindex": 60, "smolagents": 40, "agno": 30, "generic": 70}
COMPLEXITY = {"single": (1, 1, 80), "small": (2, 3, 200), "medium": (4, 7, 350), "large": (8, 999, 150)}
FINDING_TARGETS = {"STRAT-DC-001": 15, "STRAT-DC-002": 10, "STRAT-SI-001": 15, "STRAT-SI-004": 10, "STRAT-EA-001": 10, "STRAT-OC-002": 10, "STRAT-AB-001": 10, "STRAT-DC-003": 8, "STRAT-SI-002": 8,
                   "STRAT-EA-002": 8, "STRAT-OC-001": 8, "STRAT-XCOMP-001": 5, "STRAT-XCOMP-006": 5}
CONTROLS = {"human_gate": (30, 30), "schema_validation": (20, 20), "error_boundary": (20, 20), "timeout": (20, 20), "observability_sink": (15, 15), "rate_limiter": (10, 10)}
BASE_TARGET = 1000


# ---- scores of one repository -------------------------------------------------
def structural_value() -> Column:
    """Eight capped terms over agents, edges, preconditions, depth, conflicts, loops, crossings, tools."""
    cap = lambda c, n: F.least(F.col(c), F.lit(n))
    return (cap("agent_count", 10) * 2 + cap("edge_count", 30) * 0.5 + cap("precondition_count", 10) * 1.5 + cap("delegation_depth", 5) * 2 + cap("shared_state_conflicts", 5) * 2
            + F.when(F.col("feedback_loops") > 0, 3).otherwise(0) + F.when(F.col("trust_crossings") > 2, 2).otherwise(0) + cap("tool_types", 8) * 0.5)


def archetype_rarity(selected_count: Column, target: int) -> Column:
    return F.greatest(F.lit(0.0), 30.0 * (1 - selected_count / (target / ARCHETYPES)))


def runnability() -> Column:
    b = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    return (10 * b("has_entry_point") + 5 * b("has_requirements") + 5 * b("standard_framework") + 3 * b("has_usage") + 3 * (1 - b("requires_docker")) + 2 * (1 - b("requires_database")) + 2 * b("recent_commit")).cast("double")


def primary_framework(detected: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(detected, lambda f: F.lower(f)), lambda f: f.isin(SUPPORTED)), 0), F.lit("custom"))


def complexity() -> Column:
    return F.when((F.col("agent_count") <= 2) & (F.col("edge_count") <= 5), "low").when((F.col("agent_count") <= 6) & (F.col("edge_count") <= 20), "medium").otherwise("high")


def scored(repos: DataFrame, target: int, counts: DataFrame | None = None) -> DataFrame:
    """Structural value, archetype rarity, runnability and their sum; `counts` are archetypes selected so far."""
    d = repos.withColumn("runnability_score", runnability()).withColumn("structural_value", structural_value())
    if counts is not None:
        d = d.join(F.broadcast(counts.select("archetype_id", "selected")), "archetype_id", "left").fillna(0, ["selected"])  # one row per archetype
    else:
        d = d.withColumn("selected", F.lit(0))
    d = d.withColumn("archetype_rarity", archetype_rarity(F.col("selected"), target)).drop("selected")
    return d.withColumn("selection_score", F.col("structural_value") + F.col("archetype_rarity") + F.col("runnability_score")).withColumn("complexity", complexity())


def _within(df: DataFrame, key: str, order: list, name: str, limit: int) -> DataFrame:
    """Rank inside a group, keeping only ranks up to a quota (the rank limit runs before the shuffle)."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col(name) <= limit)


def select_repos(d: DataFrame, *, target: int = 1500, min_runnability: float = 15, max_per_archetype: int = 200, min_per_archetype: int = 30, control_fraction: float = 0.15, min_frameworks: int = 3) -> DataFrame:
    """A control group, archetype minima, then the best of the rest up to the target and the archetype quota.

    Quotas are rank limits. Only the last step, at most `min_frameworks` framework swaps, works
    on single rows.
    """
    by_score = [F.desc("selection_score"), F.col("repo_id")]
    ok = d.filter(F.col("runnability_score") >= min_runnability)
    control = ok.filter("precondition_count <= 1").orderBy("precondition_count", F.desc("runnability_score"), "repo_id").limit(int(target * control_fraction))
    control = cut(control.select("repo_id"))
    goal = target - int(target * control_fraction)
    rest = ok.join(F.broadcast(control), "repo_id", "left_anti")
    sizes = rest.groupBy("archetype_id").agg(F.count(F.lit(1)).alias("members"))
    ranked = _within(rest, "archetype_id", by_score, "rank_in_archetype", max_per_archetype).join(F.broadcast(sizes), "archetype_id")
    must = (F.col("members") >= min_per_archetype) & (F.col("rank_in_archetype") <= min_per_archetype)
    first = ranked.filter(must).select("repo_id", "archetype_id", "framework", "selection_score")
    chosen = cut(first)
    fill = ranked.filter(~must).select(*chosen.columns).orderBy(*by_score).limit(max(goal - chosen.count(), 0))
    chosen = cut(chosen.unionByName(fill))
    chosen = _swap_frameworks(chosen, rest.select(*chosen.columns), min_frameworks)
    out = chosen.withColumn("selection_group", F.lit("treatment"))
    extra = d.join(F.broadcast(control), "repo_id", "left_semi").select(*chosen.columns).withColumn("selection_group", F.lit("control"))
    return out.unionByName(extra)


def _swap_frameworks(chosen: DataFrame, pool: DataFrame, least: int) -> DataFrame:
    """Replace the weakest rows of the commonest framework by the best of missing frameworks."""
    have = {r["framework"]: r["n"] for r in chosen.groupBy("framework").agg(F.count(F.lit(1)).alias("n")).filter(F.col("framework").isin(SUPPORTED)).collect()}  # at most five rows
    missing = [f for f in SUPPORTED if f not in have]
    if len(have) >= least or not missing or not have:
        return chosen
    best = _within(pool.filter(F.col("framework").isin(missing)), "framework", [F.desc("selection_score"), F.col("repo_id")], "r", 1).drop("r").limit(least - len(have))
    best = cut(best)
    top = max(have, key=have.get)
    drop = chosen.filter(F.col("framework") == top).orderBy("selection_score", "repo_id").limit(best.count()).select("repo_id")
    return chosen.join(F.broadcast(cut(drop)), "repo_id", "left_anti").unionByName(best)


def archetype_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy("archetype_id").agg(F.count(F.lit(1)).alias("selected"))


def selection_summary(selected: DataFrame) -> DataFrame:
    return selected.groupBy("selection_group", "framework").agg(F.count(F.lit(1)).alias("repos"), F.avg("selection_score").alias("mean_score"))


# ---- discovery sample ---------------------------------------------------------
def bracket(agents: Column) -> Column:
    out = None
    for name, (lo, hi, _) in COMPLEXITY.items():
        out = F.when(agents.between(lo, hi), name) if out is None else out.when(agents.between(lo, hi), name)
    return out


def discovery_value(counts: dict[str, int], seen: DataFrame | None = None) -> Column:
    """Marginal value of a repository given the coverage so far; `_seen` marks known topologies.

    `counts` has at most one entry per framework, bracket, finding and control seen in the picks.
    """
    gap = lambda key, least: max(0.0, 1.0 - counts.get(key, 0) / least)
    pick = lambda col, table: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col), F.lit(0.0))
    fw = {f: 10.0 * gap(f"fw_{f}", n) for f, n in FRAMEWORK_MIN.items()}
    fw |= {k[3:]: 10.0 * gap(k, 20) for k in counts if k.startswith("fw_") and k[3:] not in FRAMEWORK_MIN}
    cx = {b: 8.0 * gap(f"cx_{b}", n) for b, (_, _, n) in COMPLEXITY.items()}
    fd = {f: (12.0 if "XCOMP" in f else 6.0) * gap(f"finding_{f}", n) for f, n in FINDING_TARGETS.items()}
    v = F.when(nz(F.col("topology_hash")).isNull(), 0.0).when(F.col("_seen"), 1.0).otherwise(15.0)
    v = v + F.when(F.col("framework").isin(list(fw)), pick(F.col("framework"), fw)).otherwise(10.0) + pick(bracket(F.col("agent_count")), cx)
    v = v + F.aggregate(F.array_distinct("finding_ids"), F.lit(0.0), lambda s, f: s + pick(f, fd))
    for c, (w, wo) in CONTROLS.items():
        v = v + F.when(F.array_contains("present_control_types", c), 4.0 * gap(f"ctrl_with_{c}", w)).otherwise(4.0 * gap(f"ctrl_without_{c}", wo))
    v = v * (0.5 + 0.5 * F.coalesce("estimated_runnability", F.lit(0.5)))
    return v + F.when(F.size("xcomp_findings") > 0, 8.0).otherwise(0.0)


def coverage_counts(picked: DataFrame) -> DataFrame:
    """(key, n): coverage counters of picked rows; frameworks, complexity bands, findings and controls are few."""
    band = F.concat(F.lit("cx_"), bracket(F.col("agent_count")))
    keys = F.concat(F.array(F.concat(F.lit("fw_"), "framework"), band), F.transform("finding_ids", lambda f: F.concat(F.lit("finding_"), f)), F.transform("present_control_types", lambda c: F.concat(F.lit("ctrl_with_"), c)))
    return picked.select(F.explode(F.array_compact(keys)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def select_for_discovery(repos: DataFrame, target: int = 1000, **lazy) -> DataFrame:
    """`repos` with pick (from 1): greedy by marginal value, scored again for each of the first twenty picks, then every fifty."""
    from spoor.operators.greedy import lazy_greedy

    cols = ["repo_id", "framework", "agent_count", "finding_ids", "present_control_types", "topology_hash", "estimated_runnability", "xcomp_findings"]
    pool = repos.select(*cols).withColumn("topology_hash", nz(F.col("topology_hash")))
    picks = lazy_greedy(pool, target, lambda n: 1 if n < 19 else 50 - n % 50, discovery_value, coverage_counts, "topology_hash", **lazy)
    return repos.join(picks.withColumn("pick", F.col("pick").cast("int")), "repo_id")


def coverage_report(selected: DataFrame, target: int) -> DataFrame:
    """(kind, name, n, least, met): coverage against targets scaled to the sample size."""
    from spoor.sources.inline import values

    scale = lambda v: max(1, round(v * target / BASE_TARGET))
    goals = [("framework", f, scale(n)) for f, n in FRAMEWORK_BASE.items()] + [("complexity", b, scale(n)) for b, (_, _, n) in COMPLEXITY.items()] + [("finding", f, n) for f, n in FINDING_TARGETS.items()]
    s = selected.select(F.explode(F.concat(F.array(F.struct(F.lit("framework").alias("kind"), F.col("framework").alias("name")), F.struct(F.lit("complexity").alias("kind"), bracket(F.col("agent_count")).alias("name"))),
                                           F.transform("finding_ids", lambda f: F.struct(F.lit("finding").alias("kind"), f.alias("name"))))).alias("x")).select("x.*").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(values(selected.sparkSession, goals, ["kind", "name", "least"])).join(s, ["kind", "name"], "left").fillna(0, ["n"]).withColumn("met", F.col("n") >= F.col("least"))


# ---- deduplication and second scoring ------------------------------------------
def structural_fingerprint() -> Column:
    return F.concat_ws(":", "framework", F.col("agent_count").cast("string"), F.array_join(F.sort_array("finding_ids"), ","))


def best_per_key(df: DataFrame, key: Column, score: str) -> DataFrame:
    """The best row per key; max_by keeps one row per key map-side."""
    return df.withColumn("_k", key).groupBy("_k").agg(F.max_by(F.struct(*df.columns), F.struct(F.col(score), F.col("repo_id"))).alias("r")).select("r.*")


def finding_prefixes(ids: Column) -> Column:
    return F.array_distinct(F.transform(ids, lambda i: F.regexp_replace(i, "-[^-]*$", "")))


def telemetry_only(ids: Column) -> Column:
    return F.forall(ids, lambda i: i.startswith("TELEMETRY"))


def short_hash(value: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(value, 256), 1, n)


def topology_hash(value: Column) -> Column:
    return F.substring(F.md5(value), 1, 8)


def diverse_order(df: DataFrame, score: str) -> DataFrame:
    """The first of each topology hash before all others, each part by score."""
    first = df.groupBy("topology_hash").agg(F.max_by("repo_id", F.struct(F.col(score), F.col("repo_id"))).alias("repo_id")).withColumn("_lead", F.lit(True))
    return df.join(first, ["topology_hash", "repo_id"], "left").withColumn("repeats", F.col("_lead").isNull()).drop("_lead")


def rule_rarity(repos: DataFrame) -> DataFrame:
    """Sum over a repository's findings of 1 / share of repositories that have the finding."""
    f = repos.select("repo_id", F.explode(F.array_distinct("finding_ids")).alias("f"))
    n = f.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    total = repos.agg(F.count(F.lit(1)).alias("t"))
    return f.join(F.broadcast(n), "f").join(F.broadcast(total)).groupBy("repo_id").agg(F.sum(F.col("t") / F.col("n")).alias("rarity"))  # n: one row per finding id


def split_ab(selected: DataFrame, score: str) -> DataFrame:
    """Alternate A / B inside each framework by score."""
    w = W.partitionBy("framework").orderBy(F.desc(score), "repo_id")
    return selected.withColumn("split", F.when((F.row_number().over(w) - 1) % 2 == 0, "A").otherwise("B"))


# ---- viability, runs, budget -----------------------------------------------------
def viability() -> Column:
    """0-100 from signals, risks and blockers (array columns)."""
    s = 50 + 8 * F.size("signals") - 5 * F.size("risks") - 25 * F.size("blockers")
    return F.least(F.lit(100), F.greatest(F.lit(0), s))


def viability_class(score: Column, blockers: Column) -> Column:
    n = F.size(blockers)
    return F.when(n >= 2, "likely_broken").when(n == 1, "needs_probe").when(score >= 70, "likely_runnable").when(score >= 40, "needs_probe").otherwise("skip")


def demote_copies(df: DataFrame) -> DataFrame:
    """Mark all but the first repository of each topology."""
    first = df.groupBy("topology_hash").agg(F.min("repo_id").alias("first_repo"))
    return df.join(first, "topology_hash").withColumn("is_copy", F.col("repo_id") != F.col("first_repo"))


# fixed values: rare preconditions
RARE = ["circular_delegation", "capability_overlap_no_priority", "data_store_no_schema_enforcement", "classification_without_validation"]


def run_count(preconditions: Column, agents: Column, complexity_: Column) -> Column:
    """3 runs plus one each for many agents, rare preconditions, semantic preconditions, high complexity; 7 at most."""
    sem = F.exists(preconditions, lambda p: p.contains("classification") | p.contains("semantic"))
    n = 3 + (agents >= 3).cast("int") + F.arrays_overlap(preconditions, F.array(*[F.lit(r) for r in RARE])).cast("int") + sem.cast("int") + (complexity_ == "high").cast("int")
    return F.least(n, F.lit(7))


def run_plan(df: DataFrame, runs: str = "runs") -> DataFrame:
    """One row per planned run: diverse inputs first, then repeats of the first input."""
    d = df.withColumn("diverse", F.floor((F.col(runs) + 1) / 2).cast("int")).withColumn("run_number", F.explode(F.sequence(F.lit(1), F.col(runs))))
    return d.withColumn("input_index", F.when(F.col("run_number") <= F.col("diverse"), F.col("run_number") - 1).otherwise(0)).withColumn("input_hash", F.substring(F.sha2(F.concat_ws("#", "repo_id", F.col("input_index").cast("string")), 256), 1, 12))


def budget(df: DataFrame, runs: str = "runs", minutes: int = 5) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_repos"), F.sum(runs).alias("total_runs"), ratio(F.sum(runs), F.count(F.lit(1))).alias("avg_runs_per_repo"), (F.sum(runs) * minutes / 60).alias("estimated_compute_hours"))


# ---- organisations and the contact queue -----------------------------------------
def enterprise_score(org: list[Column], maturity: list[Column], production: list[Column]) -> Column:
    """Three sub-scores of point columns, capped at 30, 35 and 35."""
    part = lambda cols, cap: F.least(F.lit(cap), sum(cols, F.lit(0)))
    return part(org, 30) + part(maturity, 35) + part(production, 35)


def enterprise_tier(score: Column) -> Column:
    return F.when(score >= 70, "high_value").when(score >= 45, "enterprise").when(score >= 25, "prosumer").otherwise("community")


def queue_priority(score: Column, has_contact: Column, corporate: Column, role: Column, severity: Column) -> Column:
    """Half the score (50 at most), contact quality, and the worst risk's urgency; 100 at most."""
    quality = F.when(corporate, 15).otherwise(0) + F.when(role.isin("cto", "founder"), 10).when(role.isin("lead", "maintainer"), 7).when(role == "developer", 3).otherwise(0)
    urgency = F.when(severity == "critical", 25).when(severity == "high", 18).when(severity == "medium", 10).when(severity == "low", 5).when(severity == "info", 1).otherwise(0)
    return F.least(F.lit(100), F.least(F.floor(score * 0.5), F.lit(50)) + F.when(has_contact, quality).otherwise(0) + urgency)


def tier_summary(queue: DataFrame) -> DataFrame:
    return queue.groupBy("tier").agg(F.count(F.lit(1)).alias("repos"), F.avg("priority").alias("mean_priority"))


def activity_score(stars: Column, forks: Column, days: Column) -> Column:
    """Banded stars, forks and days since the last push."""
    s = F.when(stars >= 1000, 15.0).when(stars >= 100, 10.0).when(stars >= 30, 5.0).otherwise(2.0)
    return s + F.least(forks * 0.5, F.lit(5.0)) + F.when(days < 30, 5).when(days < 90, 3).when(days < 180, 1).otherwise(0)


def diversity_ratio(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("repos"), F.count_distinct("topology_hash").alias("topologies")).withColumn("diversity", ratio(F.col("topologies"), F.col("repos")))


def repo_slug(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/]+/([^/?#]+/[^/?#]+)", 1)


def framework_census(df: DataFrame) -> DataFrame:
    return df.groupBy("framework").agg(F.count(F.lit(1)).alias("repos"), count_if(F.size("finding_ids") > 0).alias("with_findings"))
