"""Choosing the reference set of repositories: filters, value scores, coverage floors, framework caps.

Input is one row per scanned repository: repo_id, agent_count, crew_sizes, frameworks, finding_rules
(arrays), tool_count, deployment_score, has_lockfile, has_container, has_guardrails, diameter.
Scores that depend on what was chosen before are running counts over one order, not a loop. Picks are a
table; of each round only its picks are new.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spoor.functions.ordered import scan
from spoor.operators.selection import finding_prefixes, telemetry_only
from spoor.session import land

# fixed values: supported frameworks with their share of the set, and the largest agent count that is believed
FRAMEWORK_SHARE = {"LangGraph": 0.09, "AutoGen": 0.075, "CrewAI": 0.35, "LangChain": 0.485}
AGENT_CAP = 50
# fixed values: points per finding rule held by fewer repositories than the bound
RARITY_POINTS = [(50, 6), (200, 3), (500, 1)]
# fixed values: points for the number of different finding prefixes
BREADTH_POINTS = [(5, 15), (4, 10), (3, 5)]
# fixed values: points for the number of agents (from, to)
AGENT_POINTS = [(2, 2, 4), (3, 7, 20), (8, 15, 18), (16, 30, 12), (31, 50, 6)]
MAX_FINDINGS, TELEMETRY_ONLY, MAX_ARCHITECTURE, MAX_RUNNABLE, MAX_SCARCITY = 35, -10, 30, 15, 20


def raw_agents(agent_count: Column, crew_sizes: Column) -> Column:
    """Agents as counted; where fewer than two were seen, the largest crew, if one is known."""
    seen = F.coalesce(agent_count, F.lit(0))
    return F.when(seen < 2, F.coalesce(F.array_max(crew_sizes), seen)).otherwise(seen)


def agents(agent_count: Column, crew_sizes: Column) -> Column:
    return F.least(raw_agents(agent_count, crew_sizes), F.lit(AGENT_CAP))


def main_framework(frameworks: Column) -> Column:
    """The first supported framework, else the first, else 'none'."""
    known = F.filter(frameworks, lambda f: f.isin(list(FRAMEWORK_SHARE)))
    return F.coalesce(F.get(known, 0), F.get(frameworks, 0), F.lit("none"))


def telling_findings(rules: Column) -> Column:
    """Findings other than missing telemetry."""
    return F.filter(rules, lambda r: ~r.startswith("TELEMETRY"))


def described(repos: DataFrame) -> DataFrame:
    """`repos` with raw_agents, agents, framework, prefixes, n_telling and the reason for leaving it out (null: stays)."""
    none = F.array().cast("array<string>")
    d = repos.withColumns({c: F.coalesce(c, none) for c in ("frameworks", "finding_rules")})
    d = d.withColumns({
        "raw_agents": raw_agents(F.col("agent_count"), F.col("crew_sizes")), "agents": agents(F.col("agent_count"), F.col("crew_sizes")), "framework": main_framework(F.col("frameworks")),
        "prefixes": finding_prefixes(F.col("finding_rules")), "n_telling": F.size(telling_findings(F.col("finding_rules"))),
    })
    simple = (F.coalesce("tool_count", F.lit(0)) < 1) & (F.col("agents") < 3)
    why = F.when(F.col("raw_agents") < 2, "fewer than two agents").when(~F.col("framework").isin(list(FRAMEWORK_SHARE)), F.concat(F.lit("unsupported framework: "), "framework")).when(simple, "two agents without a tool")
    return d.withColumn("reason", why)


def set_fingerprint() -> Column:
    return F.concat_ws(":", "framework", F.col("agents").cast("string"), F.array_join(F.sort_array("finding_rules"), ","))


def candidates(repos: DataFrame) -> DataFrame:
    """Repositories that stay, one per fingerprint: the best deployment score, then the smallest repo_id."""
    stay = described(repos).filter("reason is null").drop("reason").withColumn("fingerprint", F.xxhash64(set_fingerprint()))
    rank = W.partitionBy("fingerprint").orderBy(F.desc(F.coalesce("deployment_score", F.lit(0))), "repo_id")
    return stay.withColumn("r", F.row_number().over(rank)).filter("r = 1").drop("r", "fingerprint")


def base_points(pool: DataFrame) -> DataFrame:
    """`pool` with finding_points, architecture_points and runnable_points, which depend on the pool alone."""
    rules = pool.select("repo_id", F.explode("finding_rules").alias("rule"))
    held = rules.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    worth = F.lit(0)
    for bound, points in reversed(RARITY_POINTS):
        worth = F.when(F.col("n") < bound, points).otherwise(worth)
    rare = rules.filter(~F.col("rule").startswith("TELEMETRY")).join(held, "rule").groupBy("repo_id").agg(F.sum(worth).alias("rare"))
    d = pool.join(rare, "repo_id", "left")
    breadth, arch = F.lit(0), F.lit(0)
    for least, points in reversed(BREADTH_POINTS):
        breadth = F.when(F.size("prefixes") >= least, points).otherwise(breadth)
    for low, high, points in AGENT_POINTS:
        arch = F.when(F.col("agents").between(low, high), points).otherwise(arch)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    found = F.when(telemetry_only(F.col("finding_rules")), TELEMETRY_ONLY).otherwise(F.least(F.coalesce("rare", F.lit(0)) + breadth, F.lit(MAX_FINDINGS)))
    arch = F.least(arch + 5 * (F.coalesce("diameter", F.lit(0)) > 2).cast("int") + 5 * flag("has_guardrails"), F.lit(MAX_ARCHITECTURE))
    run = F.least(F.least(F.coalesce("deployment_score", F.lit(0)) * 2, F.lit(10)) + 3 * flag("has_lockfile") + 2 * flag("has_container"), F.lit(MAX_RUNNABLE))
    return d.withColumns({"finding_points": found.cast("int"), "architecture_points": arch.cast("int"), "runnable_points": run.cast("int")}).drop("rare")


def scarcity_points(framework: Column, mine: Column, total: Column) -> Column:
    """Points for a framework that has less than its share of what was chosen so far."""
    share = F.lit(0.1)
    for f, s in FRAMEWORK_SHARE.items():
        share = F.when(framework == f, F.lit(s)).otherwise(share)
    gap = share - mine / F.greatest(total, F.lit(1))
    return F.when(gap > 0, F.least(F.floor(gap * 200), F.lit(MAX_SCARCITY))).otherwise(0).cast("int")


def ranked(pool: DataFrame, target: int, overshoot: float = 1.3) -> DataFrame:
    """The first `overshoot` x target candidates with their score and place (from 1).

    They are taken by the score with nothing chosen yet, then each is scored again with the frameworks of those
    before it, which is a running count over that order, and placed by the new score.
    """
    total = F.col("finding_points") + F.col("architecture_points") + F.col("runnable_points")
    none = F.lit(0)
    first = base_points(pool).withColumn("turn", -(total + scarcity_points(F.col("framework"), none, none)))
    first = land(first.orderBy("turn", "repo_id").limit(ceil(target * overshoot)).withColumn("all", F.lit(1)), "first_ranking")
    before = scan(first, ["all"], "turn", {"chosen": ("sum", F.lit(1))}, tie=["repo_id"])
    before = scan(before, ["framework"], "turn", {"chosen_mine": ("sum", F.lit(1))}, tie=["repo_id"])
    d = before.withColumn("scarcity_points", scarcity_points(F.col("framework"), F.col("chosen_mine"), F.col("chosen"))).withColumn("score", total + F.col("scarcity_points"))
    d = land(d.withColumn("down", -F.col("score")), "second_ranking")
    d = scan(d, ["all"], "down", {"place": ("sum", F.lit(1))}, tie=["chosen"], inclusive=True)
    return d.drop("all", "turn", "down", "chosen", "chosen_mine")


def fill_floors(chosen: DataFrame, pool: DataFrame, groups: list[list[tuple[str, Column, int]]], start: int) -> DataFrame:
    """(repo_id, coverage_fill, place): what is added for floors (name, condition, least), group by group.

    What a group's floors lack is counted once, over what was chosen and what earlier groups added. For a floor, the
    candidates not yet taken with the most telling findings come first, ties by repo_id. The pool is read once: of each
    condition the first sum of all needs are enough, and the rounds work on that bounded table.
    """
    floors = [f for g in groups for f in g]
    marks = [F.coalesce(cond, F.lit(False)).alias(f"f{i}") for i, (_, cond, _) in enumerate(floors)]
    have = chosen.select(*marks).agg(*[F.sum(F.col(f"f{i}").cast("int")).alias(f"f{i}") for i in range(len(floors))]).first()
    lacks = [max(0, least - (have[f"f{i}"] or 0)) for i, (_, _, least) in enumerate(floors)]
    picks = pool.select("repo_id").limit(0).withColumns({"coverage_fill": F.lit(""), "place": F.lit(0).cast("long")})
    if not sum(lacks):
        return picks
    left = pool.select("repo_id", "n_telling", *marks).join(chosen.select("repo_id"), "repo_id", "left_anti")
    order = [F.desc("n_telling"), F.col("repo_id")]
    tall = left.select("*", F.explode(F.array_compact(F.array(*[F.when(F.col(f"f{i}"), F.lit(i)) for i in range(len(floors)) if lacks[i]]))).alias("floor"))
    near = tall.withColumn("r", F.row_number().over(W.partitionBy("floor").orderBy(*order))).filter(F.col("r") <= sum(lacks))
    near = land(near.drop("r"), "floor_candidates")  # at most floors x needs rows
    i = 0
    for group in groups:
        taken = near.join(picks.select("repo_id"), "repo_id", "left_semi").groupBy("floor").count()
        taken = {r["floor"]: r["count"] for r in taken.collect()} if i else {}  # one row a floor
        for name, _, _ in group:
            need = lacks[i] - taken.get(i, 0)
            if need > 0:
                now = near.filter(F.col("floor") == i).join(picks.select("repo_id"), "repo_id", "left_anti").orderBy(*order).limit(need)
                now = now.withColumn("place", F.row_number().over(W.orderBy(*order)) + start + picks.count()).select("repo_id", F.lit(name).alias("coverage_fill"), F.col("place").cast("long"))
                picks = land(picks.unionByName(now), "floor_picks")
            i += 1
    return picks


def choose(repos: DataFrame, *, target: int = 4000, per_framework: int = 80, per_prefix: int = 30, with_guardrails: int = 100, slack: float = 1.1) -> DataFrame:
    """The reference set: repo_id, framework, agents, raw_agents, finding_rules, n_telling, score, its parts, coverage_fill, place, split.

    The best `target` by score, filled up to the floors of frameworks, finding prefixes (by name) and guardrails;
    if that is more than `target`, frameworks beyond their share (times `slack`) lose their lowest scores, and the
    best `target` stay. `split` alternates A and B inside a framework. Repeated repo_ids count as one repository
    each; nulls in any column count as absent. An empty table gives an empty set.
    """
    pool = land(candidates(repos), "set_candidates")
    best = land(ranked(pool, target).filter(F.col("place") <= target), "set_ranked")
    prefixes = [r["p"] for r in pool.select(F.explode("prefixes").alias("p")).distinct().orderBy("p").collect()]  # one a family of rules
    groups = [
        [(f"framework_floor:{f}", F.col("framework") == f, per_framework) for f in sorted(FRAMEWORK_SHARE)],
        [(f"finding_prefix_floor:{p}", F.array_contains("prefixes", p), per_prefix) for p in prefixes],
        [("guardrail_floor", F.col("has_guardrails"), with_guardrails)],
    ]
    fills = fill_floors(best, pool, groups, target)
    parts = ["finding_points", "architecture_points", "runnable_points", "scarcity_points", "score"]
    some = pool.join(fills, "repo_id").withColumns({p: F.lit(0).cast(best.schema[p].dataType) for p in parts})
    both = best.withColumn("coverage_fill", F.lit(None).cast("string")).unionByName(some.select(*best.columns, "coverage_fill"))
    if both.count() > target:
        cap = F.lit(target)
        for f, s in FRAMEWORK_SHARE.items():
            cap = F.when(F.col("framework") == f, int(target * s * slack)).otherwise(cap)
        inside = W.partitionBy("framework").orderBy(F.desc("score"), "place")  # at most target + floors rows
        both = both.withColumn("r", F.row_number().over(inside)).filter(F.col("r") <= cap).drop("r").orderBy(F.desc("score"), "place").limit(target)
    turn = F.row_number().over(W.partitionBy("framework").orderBy(F.desc("score"), "place"))
    out = both.withColumn("split", F.when(turn % 2 == 1, "A").otherwise("B"))
    return out.select("repo_id", "framework", "agents", "raw_agents", "finding_rules", "prefixes", "n_telling", "has_guardrails", *parts, "coverage_fill", "place", "split")


def set_summary(chosen: DataFrame) -> DataFrame:
    """(kind, name, n) over frameworks, prefixes, fills and splits in one pass."""
    facts = F.array(
        F.struct(F.lit("framework").alias("kind"), F.col("framework").alias("name")), F.struct(F.lit("split").alias("kind"), F.col("split").alias("name")),
        F.struct(F.lit("fill").alias("kind"), F.coalesce("coverage_fill", F.lit("none")).alias("name")))
    facts = F.concat(facts, F.transform("prefixes", lambda p: F.struct(F.lit("prefix").alias("kind"), p.alias("name"))))
    return chosen.select(F.explode(facts).alias("f")).groupBy("f.kind", "f.name").agg(F.count(F.lit(1)).alias("n"))


# ---- value of one scanned graph -------------------------------------------------
# fixed values: (points, condition) over the columns of a scanned repository
SCAN_RULES = [
    (10, "known_framework"), (5, "has_entry_point"), (5, "has_requirements"), (3, "graph_agents >= 2"), (3, "n_py > 0 AND n_py < 20"), (-10, "server_code"), (-5, "n_external_apis > 5"), (-5, "n_py > 50"), (-3, "n_py > 30 AND n_py <= 50"),
    (10, "preferred_framework"), (8, "agent_count BETWEEN 2 AND 10"), (5, "has_lockfile"), (5, "array_contains(llm_providers, 'openai')"), (3, "agent_count BETWEEN 2 AND 5"), (2, "n_versions > 0"), (-10, "server_framework"),
    (-5, "agent_count > 20"), (-5, "agent_count = 0"), (-3, "size(llm_providers) > 0 AND NOT array_contains(llm_providers, 'openai')"), (-15, "is_fork"), (15, "tool_count > 0 OR graph_tools > 0"), (12, "n_delegations > 0 OR has_delegation_hint"),
    (10, "data_store_count > 0"), (8, "has_routing_hint"), (8, "agent_count BETWEEN 3 AND 7"), (5, "has_error_hint"),
]
CROSS_COMPONENT = 1.7


def cross_component() -> Column:
    """At least two of tools, data stores, external services and guards."""
    return sum(((F.coalesce(F.col(c), F.lit(0)) > 0).cast("int") for c in ("tool_count", "data_store_count", "external_service_count", "guard_count")), F.lit(0)) >= 2


def scan_score() -> Column:
    """Additive rules, two points a delegation (10 at most) and one a tool (5 at most); more for graphs across components."""
    points = sum((F.when(F.expr(cond), p).otherwise(0) for p, cond in SCAN_RULES), F.lit(0))
    points = points + F.least(F.coalesce("n_delegations", F.lit(0)) * 2, F.lit(10)) + F.least(F.coalesce("graph_tools", F.lit(0)), F.lit(5))
    return F.round(points * F.when(cross_component(), CROSS_COMPONENT).otherwise(1.0), 2)


def loaded_scans(scans: DataFrame, *, include_forks: bool = False, dedup: bool = True) -> DataFrame:
    """Scans with url (from the name where absent), score and is_cross_component; forks left out, one per size and frameworks if asked."""
    url = F.coalesce("repo_url", F.concat(F.lit("https://github.com/"), "repo_full_name"))
    d = scans.withColumns({"url": url, "score": scan_score(), "is_cross_component": cross_component()}).filter(F.col("url").isNotNull())
    d = d if include_forks else d.filter(~F.coalesce("is_fork", F.lit(False)))
    if dedup:
        key = F.xxhash64(F.coalesce("agent_count", F.lit(-1)), F.array_join(F.sort_array("frameworks"), ","), F.coalesce("primary_framework", F.lit("")))
        d = d.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "url"))).filter("r = 1").drop("r")
    return d
