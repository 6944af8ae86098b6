"""Registered queries: the reference set chosen from scanned repositories (customers with their orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.operators import reference_set as R
from spoor.plans.corpus import Corpus, Query
from spoor.plans.q_matching import trade_features
from spoor.sources.trade import sql_trade

TARGET, FLOORS = 60, {"per_framework": 16, "per_prefix": 45, "with_guardrails": 25}
PREFIX = "CASE o_orderpriority WHEN '1-URGENT' THEN 'STRATUM' WHEN '2-HIGH' THEN 'CONTEXT' WHEN '3-MEDIUM' THEN 'TELEMETRY' WHEN '4-NOT SPECIFIED' THEN 'OPERABILITY' ELSE 'IDENTITY' END"
RULE = f"CASE WHEN l_quantity > 46 THEN concat({PREFIX}, '-', CAST(l_partkey % 30 AS VARCHAR(9))) WHEN l_quantity < 3 AND l_tax > 0.07 THEN concat('RARE-', CAST(l_suppkey % 4 AS VARCHAR(9))) END"
LISTS = ["['LangGraph']", "['OpenAI', 'AutoGen']", "['CrewAI']", "['LangChain', 'CrewAI']", "['LangChain']", "['Dify']", "[]"]
# columns of a scan over b (cents of a balance), the order counts and the nation
SCAN = {
    "repo_id": "concat('firm_', c_custkey)", "agent_count": "CASE WHEN b % 9 = 0 THEN n_lines WHEN b % 7 = 0 THEN 1 ELSE n_orders % 13 END", "tool_count": "b % 3", "deployment_score": "b % 6",
    "has_lockfile": "b % 3 = 0", "has_container": "b % 5 = 0", "has_guardrails": "b % 11 = 0", "diameter": "b % 5",
}
HINTS = {
    "repo_full_name": "concat('org', c_nationkey, '/firm', c_custkey)", "repo_url": "CASE WHEN b % 2 = 0 THEN concat('https://github.com/o/f', c_custkey) END", "known_framework": "b % 2 = 1", "has_entry_point": "b % 3 = 1", "has_requirements": "b % 5 < 3",
    "n_py": "b % 70", "server_code": "b % 13 = 0", "n_external_apis": "b % 8", "preferred_framework": "c_nationkey % 3 = 0", "n_versions": "b % 2", "server_framework": "b % 17 = 0", "is_fork": "b % 10 = 3",
    "has_delegation_hint": "b % 19 = 0", "has_routing_hint": "b % 7 = 2", "has_error_hint": "b % 6 = 5", "primary_framework": "CASE WHEN b % 4 > 0 THEN c_mktsegment END",
}


def scans(c: Corpus):
    def build():
        line = c.table("lineitem").join(c.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        per = line.groupBy("o_custkey").agg(F.count_distinct("l_orderkey").alias("n_orders"), F.count("*").alias("n_lines"), F.sort_array(F.collect_set(F.expr(RULE.replace("VARCHAR(9)", "STRING")))).alias("finding_rules"))
        crews = line.groupBy("o_custkey", "l_orderkey").count().groupBy("o_custkey").agg(F.sort_array(F.collect_list("count")).alias("crew_sizes"))
        d = c.table("customer").withColumn("b", F.abs(F.expr("CAST(round(c_acctbal * 100) AS BIGINT)"))).join(per, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
        d = d.join(crews, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["n_orders", "n_lines"])
        lists = F.array(*[F.expr("array(" + x.strip("[]") + ")").cast("array<string>") for x in LISTS])
        providers = F.when(F.col("b") % 3 == 0, F.array(F.lit("openai"), F.lit("other"))).when(F.col("b") % 3 == 1, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>"))
        texts = {k: F.expr(v) for k, v in (SCAN | HINTS).items()}
        return d.select(*[v.alias(k) for k, v in texts.items()], F.get(lists, (F.col("c_nationkey") % len(LISTS)).cast("int")).alias("frameworks"), "finding_rules", "crew_sizes", providers.alias("llm_providers"))

    return c.keep("reference_scans", build)


def chosen(c: Corpus):
    return c.keep("reference_set", lambda: R.choose(scans(c), target=TARGET, **FLOORS))


def scan_rows(c: Corpus):
    """Scans with the counts of their order graph."""
    f = trade_features(c).select("repo_id", F.col("agent_count").alias("graph_agents"), F.col("capability_count").alias("graph_tools"), F.col("data_store_count"), F.col("external_count").alias("external_service_count"), F.col("guardrail_count").alias("guard_count"))
    d = c.trade_edges.filter("edge_type = 'delegates_to'").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_delegations"))
    return scans(c).join(f, "repo_id").join(d, "repo_id", "left").fillna(0, ["n_delegations"])


_CU = (
    f"ln AS (SELECT o_custkey, l_orderkey, {RULE} AS rule FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "pe AS (SELECT o_custkey, count(DISTINCT l_orderkey) AS n_orders, count(*) AS n_lines, list(DISTINCT rule) FILTER (rule IS NOT NULL) AS finding_rules FROM ln GROUP BY 1), "
    "cr AS (SELECT o_custkey, max(k) AS crew FROM (SELECT o_custkey, l_orderkey, count(*) AS k FROM ln GROUP BY ALL) GROUP BY 1), "
    "cb AS (SELECT customer.*, abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS b, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines, coalesce(finding_rules, []) AS finding_rules, crew FROM customer LEFT JOIN pe ON pe.o_custkey = c_custkey LEFT JOIN cr ON cr.o_custkey = c_custkey), "
    "cs AS MATERIALIZED (SELECT " + ", ".join(f"{t} AS {k}" for k, t in (SCAN | HINTS).items()) + ", CASE c_nationkey % " + str(len(LISTS)) + " " + " ".join(f"WHEN {i} THEN {x}::VARCHAR[]" for i, x in enumerate(LISTS)) + " END AS frameworks, finding_rules, crew, "
    "CASE b % 3 WHEN 0 THEN ['openai', 'other'] WHEN 1 THEN ['other'] ELSE []::VARCHAR[] END AS llm_providers FROM cb), "
)
_SUP = "['" + "', '".join(R.FRAMEWORK_SHARE) + "']"
_DESC = _CU + (
    f"ds AS MATERIALIZED (SELECT *, least(raw_agents, {R.AGENT_CAP}) AS agents, CASE WHEN raw_agents < 2 THEN 'fewer than two agents' WHEN NOT list_contains({_SUP}, framework) THEN 'unsupported framework: ' || framework WHEN tool_count < 1 AND raw_agents < 3 THEN 'two agents without a tool' END AS reason "
    f"FROM (SELECT *, CASE WHEN agent_count < 2 THEN coalesce(crew, agent_count) ELSE agent_count END AS raw_agents, coalesce(list_filter(frameworks, lambda f: list_contains({_SUP}, f))[1], frameworks[1], 'none') AS framework, "
    "list_distinct(list_transform(finding_rules, lambda r: regexp_replace(r, '-[^-]*$', ''))) AS prefixes, len(list_filter(finding_rules, lambda r: NOT starts_with(r, 'TELEMETRY'))) AS n_telling FROM cs)), "
    "pl AS MATERIALIZED (SELECT * FROM ds WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY framework, agents, list_sort(finding_rules) ORDER BY deployment_score DESC, repo_id) = 1), "
    "rl AS (SELECT repo_id, unnest(finding_rules) AS rule FROM pl), rn AS (SELECT rule, count(*) AS n FROM rl GROUP BY 1), "
    "rr AS (SELECT repo_id, sum(CASE " + " ".join(f"WHEN n < {b} THEN {p}" for b, p in R.RARITY_POINTS) + " ELSE 0 END) AS rare FROM rl JOIN rn USING (rule) WHERE NOT starts_with(rule, 'TELEMETRY') GROUP BY 1), "
    f"bp AS MATERIALIZED (SELECT pl.*, CASE WHEN len(list_filter(finding_rules, lambda r: NOT starts_with(r, 'TELEMETRY'))) = 0 THEN {R.TELEMETRY_ONLY} ELSE least(coalesce(rare, 0) + CASE " + " ".join(f"WHEN len(prefixes) >= {k} THEN {p}" for k, p in R.BREADTH_POINTS) + f" ELSE 0 END, {R.MAX_FINDINGS}) END::INT AS finding_points, "
    "least(CASE " + " ".join(f"WHEN agents BETWEEN {a} AND {b} THEN {p}" for a, b, p in R.AGENT_POINTS) + f" ELSE 0 END + 5 * (diameter > 2)::INT + 5 * has_guardrails::INT, {R.MAX_ARCHITECTURE})::INT AS architecture_points, "
    f"least(least(deployment_score * 2, 10) + 3 * has_lockfile::INT + 2 * has_container::INT, {R.MAX_RUNNABLE})::INT AS runnable_points, CASE framework " + " ".join(f"WHEN '{f}' THEN {s}::DOUBLE" for f, s in R.FRAMEWORK_SHARE.items()) + " ELSE 0.1 END AS share FROM pl LEFT JOIN rr USING (repo_id)), "
    "t1 AS MATERIALIZED (SELECT *, finding_points + architecture_points + runnable_points AS base, row_number() OVER (ORDER BY base + least(floor(share * 200), 20) DESC, repo_id) AS turn FROM bp QUALIFY turn <= " + str(-(-TARGET * 13 // 10)) + "), "
    f"t2 AS MATERIALIZED (SELECT *, share - (row_number() OVER (PARTITION BY framework ORDER BY turn) - 1) / greatest(turn - 1, 1) AS gap, (CASE WHEN gap > 0 THEN least(floor(gap * 200), {R.MAX_SCARCITY}) ELSE 0 END)::INT AS scarcity_points, base + scarcity_points AS score FROM t1), "
    "t3 AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, turn) AS place FROM t2 QUALIFY place <= " + str(TARGET) + "), "
)
_PREFIXES = ["CONTEXT", "IDENTITY", "OPERABILITY", "RARE", "STRATUM", "TELEMETRY"]


def _floors() -> str:
    """One CTE of picks a floor, each leaving out what earlier ones took; needs are counted per group of floors."""
    out, names = "", []
    groups = [
        [(f"framework_floor:{f}", f"framework = '{f}'", FLOORS["per_framework"]) for f in sorted(R.FRAMEWORK_SHARE)],
        [(f"finding_prefix_floor:{p}", f"list_contains(prefixes, '{p}')", FLOORS["per_prefix"]) for p in _PREFIXES],
        [("guardrail_floor", "has_guardrails", FLOORS["with_guardrails"])],
    ]
    for group in groups:
        counted = " UNION ALL ".join(["SELECT repo_id FROM t3", *[f"SELECT repo_id FROM {n}" for n in names]])
        for name, cond, least in group:
            taken = " UNION ALL ".join(["SELECT repo_id FROM t3", *[f"SELECT repo_id FROM {n}" for n in names]])
            out += f"q{len(names)} AS MATERIALIZED (SELECT repo_id, '{name}' AS coverage_fill, row_number() OVER (ORDER BY n_telling DESC, repo_id) AS r FROM pl WHERE {cond} AND repo_id NOT IN ({taken}) QUALIFY r <= {least} - (SELECT count(*) FROM pl WHERE {cond} AND repo_id IN ({counted}))), "
            names.append(f"q{len(names)}")
    every = " UNION ALL ".join(f"SELECT {i} AS k, * FROM {n}" for i, n in enumerate(names))
    return out + f"fl AS MATERIALIZED (SELECT repo_id, coverage_fill, {TARGET} + row_number() OVER (ORDER BY k, r) AS place FROM ({every})), "


_SET = _DESC + _floors() + (
    "un AS (SELECT repo_id, framework, agents, raw_agents, n_telling, prefixes, has_guardrails, finding_points, architecture_points, runnable_points, scarcity_points, score, NULL AS coverage_fill, place FROM t3 "
    "UNION ALL SELECT repo_id, framework, agents, raw_agents, n_telling, prefixes, has_guardrails, 0, 0, 0, 0, 0, coverage_fill, place FROM fl JOIN pl USING (repo_id)), "
    "cp AS (SELECT *, row_number() OVER (PARTITION BY framework ORDER BY score DESC, place) AS r, count(*) OVER () AS total FROM un), "
    "ck AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, place) AS k FROM cp WHERE total <= " + str(TARGET) + " OR r <= CASE framework " + " ".join(f"WHEN '{f}' THEN {int(TARGET * s * 1.1)}" for f, s in R.FRAMEWORK_SHARE.items()) + " END), "
    "st AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER (PARTITION BY framework ORDER BY score DESC, place) % 2 = 1 THEN 'A' ELSE 'B' END AS split FROM ck WHERE k <= " + str(TARGET) + " OR total <= " + str(TARGET) + ") "
)
_SCAN_SQL = _CU + sql_trade() + (
    "dg AS (SELECT repo_id, count(*) AS n_delegations FROM tedges WHERE edge_type = 'delegates_to' GROUP BY 1), gn AS (SELECT repo_id, count(*) FILTER (node_type = 'agent') AS graph_agents, count(*) FILTER (node_type = 'capability') AS graph_tools, count(*) FILTER (node_type = 'data_store') AS data_store_count, "
    "count(*) FILTER (node_type = 'external') AS external_service_count, count(*) FILTER (node_type = 'guardrail') AS guard_count FROM tnodes GROUP BY 1), "
    "sr AS (SELECT cs.*, gn.* EXCLUDE (repo_id), coalesce(n_delegations, 0) AS n_delegations FROM cs JOIN gn USING (repo_id) LEFT JOIN dg USING (repo_id)), "
    "sx AS (SELECT *, (tool_count > 0)::INT + (data_store_count > 0)::INT + (external_service_count > 0)::INT + (guard_count > 0)::INT >= 2 AS is_cross_component, coalesce(repo_url, 'https://github.com/' || repo_full_name) AS url, "
    + " + ".join(f"CASE WHEN {c.replace('array_contains', 'list_contains').replace('size(', 'len(')} THEN {p} ELSE 0 END" for p, c in R.SCAN_RULES) + " + least(n_delegations * 2, 10) + least(graph_tools, 5) AS points FROM sr), "
    f"sy AS (SELECT *, round(points * CASE WHEN is_cross_component THEN {R.CROSS_COMPONENT}::DOUBLE ELSE 1 END, 2) AS score FROM sx WHERE NOT is_fork) "
    "SELECT repo_id, url, score, is_cross_component FROM sy QUALIFY row_number() OVER (PARTITION BY agent_count, list_sort(frameworks), coalesce(primary_framework, '') ORDER BY score DESC, url) = 1"
)

QUERIES = [
    Query("n20_filter_reasons", lambda c: R.described(scans(c)).select("repo_id", "raw_agents", "agents", "framework", "n_telling", "reason"), "WITH " + _DESC.rstrip(", ") + " SELECT repo_id, raw_agents, agents, framework, CAST(n_telling AS INTEGER) AS n_telling, reason FROM ds"),
    Query("n22_value_points", lambda c: R.base_points(R.candidates(scans(c))).select("repo_id", "finding_points", "architecture_points", "runnable_points"), "WITH " + _DESC.rstrip(", ") + " SELECT repo_id, finding_points, architecture_points, runnable_points FROM bp"),
    Query("n23_ranked_repos", lambda c: R.ranked(R.candidates(scans(c)), TARGET).filter(F.col("place") <= TARGET).select("repo_id", "scarcity_points", "score", "place"), "WITH " + _DESC.rstrip(", ") + " SELECT repo_id, scarcity_points, score, place FROM t3"),
    Query("n24_reference_set", lambda c: chosen(c).select("repo_id", "framework", "score", "coverage_fill", "place", "split"), "WITH " + _SET + "SELECT repo_id, framework, score, coverage_fill, place, split FROM st"),
    Query("n25_set_summary", lambda c: R.set_summary(chosen(c)), "WITH " + _SET + ", fa AS (SELECT 'framework' AS kind, framework AS name FROM st UNION ALL SELECT 'split', split FROM st UNION ALL SELECT 'fill', coalesce(coverage_fill, 'none') FROM st UNION ALL SELECT 'prefix', unnest(prefixes) FROM st) SELECT kind, name, count(*) AS n FROM fa GROUP BY ALL"),
    Query("n29_scan_scores", lambda c: R.loaded_scans(scan_rows(c)).select("repo_id", "url", "score", "is_cross_component"), "WITH " + _SCAN_SQL),
]
