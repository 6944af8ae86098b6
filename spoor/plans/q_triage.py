"""Registered queries: entry points, maturity and semantic findings of repositories (customers with their order lines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.operators import semantic as L
from spoor.operators import triage as T
from spoor.plans.corpus import Corpus, Query, r6

PATHS = ["main.py", "./app.py", "src/run.py", "run.py", "cli.py", "examples/demo1.py", "tests/test_a.py", "pkg/__main__.py", "docs/Demo.py", "Dockerfile", ".github/workflows/ci.yml", ".env", "ops/Prometheus.yaml", "infra/vault.hcl", "tests/test_b.py", "testing", "k8s/x.yaml", "readme.md", "demo.txt"]
PATH = "CASE l_partkey % " + str(len(PATHS)) + " " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATHS)) + " END"
B = "abs(CAST(round(c_acctbal * 100) AS BIGINT))"
REPO = {
    "repo_id": "concat('firm_', c_custkey)", "is_organization": "b % 2 = 0", "website": "CASE WHEN b % 3 = 0 THEN 'x.org' END", "homepage": "CASE WHEN b % 5 = 0 THEN 'h.org' WHEN b % 5 = 1 THEN '' END", "public_repos": "CASE WHEN b % 7 > 0 THEN b % 20 END",
    "contributors": "CASE WHEN b % 11 > 0 THEN b % 8 END", "pushed_at": "CASE WHEN b % 4 = 0 THEN '2024-05-01 00:00:00' WHEN b % 4 = 1 THEN '2023-01-01 00:00:00' END", "readme": "CASE b % 3 WHEN 0 THEN 'How to Deploy it' WHEN 1 THEN 'redeployed' END", "license": "CASE b % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-3.0' END",
}
NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def files(c: Corpus):
    line = c.table("lineitem").filter("l_quantity > 25").join(c.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return line.select(F.expr("concat('firm_', o_custkey)").alias("repo_id"), F.expr(PATH).alias("path"))


def repos(c: Corpus):
    return c.table("customer").withColumn("b", F.expr(B)).select(*[F.expr(t).alias(n) for n, t in REPO.items()], "b")


def starts(c: Corpus):
    r = repos(c)
    packages = r.select("repo_id", F.expr("CASE b % 3 WHEN 0 THEN 'pkg' WHEN 1 THEN '' END").alias("primary_package"))
    commands = r.filter("b % 6 = 0").select("repo_id", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("pkg.tool:main").alias("entry_point")), F.struct(F.lit(1).alias("ord"), F.lit("other").alias("entry_point")))).alias("e")).select("repo_id", "e.*")
    return T.entry_points(files(c), packages, commands)


def findings(c: Corpus):
    o = c.table("orders").withColumn("repo_id", F.expr("concat('firm_', o_custkey)"))
    line = c.table("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    fidelity = line.select("repo_id", F.expr("concat('s', l_suppkey % 3)").alias("source"), F.expr("concat('s', l_suppkey % 4)").alias("target"), F.expr("l_orderkey * 10 + l_linenumber").alias("ord"), F.expr("l_quantity < 20").alias("hedging_preserved"), F.expr("l_discount > 0.02").alias("factual_additions"), F.expr("CASE l_returnflag WHEN 'R' THEN 'omission' WHEN 'A' THEN 'distortion' END").alias("mode"), F.expr("l_tax > 0.075").alias("failed"))
    chains = o.select("repo_id", F.expr("concat('run_', o_orderkey)").alias("run_id"), F.expr("o_orderkey % 3 = 0").alias("information_accretion"), F.expr("CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 10 / 10 END").alias("chain_fidelity"))
    escalations = line.select("repo_id", F.expr("concat('run_', o_orderkey)").alias("run_id"), F.expr("concat('s', l_suppkey)").alias("node"), F.expr("l_partkey % 2 = 0").alias("compensatory_assertion"), F.expr("CASE l_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END").alias("fabrication_risk"), F.expr("l_linenumber > 3").alias("had_preceding_errors"), F.col("l_linenumber").alias("call_count"))
    r = repos(c)
    stability = r.select("repo_id", F.lit("n").alias("node"), F.expr("CASE WHEN b % 9 > 0 THEN b % 100 / 100 END").alias("stability_score"))
    weak = r.select("repo_id", F.lit("n").alias("node"), F.expr("b % 50 / 50").alias("vulnerability_score"), F.expr("CASE WHEN b % 4 > 0 THEN b % 4 - 1 END").alias("defense_count"))
    return L.semantic_findings(fidelity, chains, escalations, stability, weak)


_FI = (
    f"cb AS MATERIALIZED (SELECT *, {B} AS b FROM customer), rp AS (SELECT " + ", ".join(f"{t} AS {n}" for n, t in REPO.items()) + ", b FROM cb), "
    f"fi AS MATERIALIZED (SELECT DISTINCT concat('firm_', o_custkey) AS repo_id, {PATH} AS raw, regexp_replace(raw, '^\\./', '') AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 25), "
)
_ST = _FI + (
    "ep AS (SELECT repo_id, path, 'standard_file' AS strategy, CASE path " + " ".join(f"WHEN '{n}' THEN {v}::DOUBLE" for n, v in T.START_FILES.items()) + " END AS confidence, 1 AS part, path AS tie, 'python ' || path AS command FROM fi WHERE path IN (" + ", ".join(f"'{n}'" for n in T.START_FILES) + ") "
    "UNION ALL SELECT repo_id, path, 'package_main', 0.85, 2, path, 'python -m pkg' FROM fi JOIN rp USING (repo_id) WHERE b % 3 = 0 AND path = 'pkg/__main__.py' UNION ALL SELECT repo_id, path, 'example_script', 0.6, 3, path, 'python ' || path FROM fi WHERE (contains(lower(path), 'example') OR contains(lower(path), 'demo')) AND path LIKE '%.py' "
    "UNION ALL SELECT repo_id, min(path), 'test_execution', 0.5, 4, min(path), 'pytest ' || min(path) || ' -x --timeout=120' FROM fi WHERE contains(lower(path), 'test') AND path LIKE '%.py' GROUP BY repo_id "
    "UNION ALL SELECT repo_id, e, 'cli_entry_point', 0.9, 0, lpad(CAST(i AS VARCHAR), 12, '0'), 'python -m ' || replace(string_split(e, ':')[1], '.', '/') FROM rp, (VALUES (0, 'pkg.tool:main'), (1, 'other')) AS t(i, e) WHERE b % 6 = 0) "
    "SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY confidence DESC, part, tie) AS INTEGER) AS rank, path, strategy, confidence, command FROM ep"
)
_any = lambda words, x: "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"
_head = lambda words, x: "(" + " OR ".join(f"starts_with({x}, '{w}')" for w in words) + ")"
_MA = _FI + (
    f"mk AS (SELECT repo_id, bool_or({_head(T.CI_PATHS, 'raw')}) AS ci, bool_or({_head(T.CONTAINER_FILES, 'raw')}) AS ct, bool_or({_any(T.MONITORING_WORDS, 'raw')}) AS mo, bool_or(raw IN ('.env', '.env.example')) AS en, bool_or({_any(T.SECRET_WORDS, 'raw')}) AS se, bool_or(" + " OR ".join(f"raw = '{t}' OR starts_with(raw, '{t}/')" for t in T.TEST_FOLDERS) + ") AS te FROM fi GROUP BY 1) "
    "SELECT repo_id, CAST(least(30, 10 * is_organization::INT + CASE WHEN (public_repos IS NOT NULL AND website IS NOT NULL) OR coalesce(homepage, '') <> '' THEN 10 ELSE 0 END + CASE WHEN public_repos >= 10 THEN 5 ELSE 0 END + CASE WHEN contributors >= 5 THEN 5 ELSE 0 END) AS INTEGER) AS org_signals, "
    "CAST(least(35, 10 * coalesce(ci, false)::INT + 5 * coalesce(ct, false)::INT + 5 * coalesce(mo, false)::INT + CASE WHEN contributors >= 3 THEN 5 ELSE 0 END + CASE WHEN b % 4 = 0 THEN 5 ELSE 0 END) AS INTEGER) AS code_maturity, "
    "CAST(least(35, CASE WHEN b % 3 = 0 THEN 10 ELSE 0 END + 5 * coalesce(en, false)::INT + 5 * coalesce(se, false)::INT + CASE WHEN b % 3 = 0 THEN 5 ELSE 0 END + 5 * coalesce(te, false)::INT) AS INTEGER) AS production_signals FROM rp LEFT JOIN mk USING (repo_id)"
)
_NM = "CASE finding_id " + " ".join(f"WHEN '{f}' THEN '{n}'" for f, (n, _) in L.SEMANTIC_FINDINGS.items()) + " END AS finding_name, CASE finding_id " + " ".join(f"WHEN '{f}' THEN '{s}'" for f, (_, s) in L.SEMANTIC_FINDINGS.items()) + " END AS severity"
_SF = (
    f"cb AS MATERIALIZED (SELECT concat('firm_', c_custkey) AS repo_id, {B} AS b FROM customer), ln AS MATERIALIZED (SELECT *, concat('firm_', o_custkey) AS repo_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "dr AS (SELECT repo_id, concat('s', l_suppkey % 3, '->s', l_suppkey % 4) AS subject, round(count(*) FILTER (l_quantity >= 20 AND l_discount > 0.02) / count(*), 2) AS measure, count(*) FILTER (l_quantity >= 20 AND l_discount > 0.02) / count(*) AS r FROM ln WHERE l_tax <= 0.075 GROUP BY ALL HAVING count(*) >= 2 AND r > 0.5), "
    "fs AS (SELECT repo_id, 'STRAT-SD-001' AS finding_id, subject, measure FROM dr UNION ALL SELECT concat('firm_', o_custkey), 'STRAT-HC-001', concat('run_', o_orderkey), o_orderkey % 10 / 10 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 > 0 AND o_orderkey % 10 < 5 "
    "UNION ALL SELECT repo_id, 'STRAT-CE-001', concat('run_', o_orderkey, '/s', l_suppkey), l_linenumber FROM ln WHERE l_partkey % 2 = 0 AND l_partkey % 3 = 0 AND l_linenumber > 3 UNION ALL SELECT repo_id, 'STRAT-SC-001', 'n', b % 100 / 100 FROM cb WHERE b % 9 > 0 AND b % 100 < 50 "
    "UNION ALL SELECT repo_id, 'STRAT-TV-001', 'n', b % 50 / 50 FROM cb WHERE b % 50 > 35 AND b % 4 < 2) "
)
_DM = (
    "ln AS MATERIALIZED (SELECT *, concat('firm_', o_custkey) AS repo_id, concat('s', l_suppkey % 3) AS source, concat('s', l_suppkey % 4) AS target, coalesce(CASE l_returnflag WHEN 'R' THEN 'omission' WHEN 'A' THEN 'distortion' END, 'unknown') AS mode FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_tax <= 0.075), "
    "mo AS (SELECT repo_id, source, target, mode, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f, count(*) FILTER (l_quantity >= 20 AND l_discount > 0.02) AS d FROM ln GROUP BY ALL) "
    "SELECT repo_id, source, target, round(sum(d) / sum(n), 2) AS drift_rate, arg_min(mode, struct_pack(n := -n, f := f, m := mode)) AS mode, CAST(sum(n) AS BIGINT) AS measurements FROM mo GROUP BY ALL HAVING sum(n) >= 2 AND sum(d) / sum(n) > 0.5"
)


def drifting(c: Corpus):
    line = c.table("lineitem").join(c.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return L.drifting_edges(line.select(F.expr("concat('firm_', o_custkey)").alias("repo_id"), F.expr("concat('s', l_suppkey % 3)").alias("source"), F.expr("concat('s', l_suppkey % 4)").alias("target"), F.expr("l_orderkey * 10 + l_linenumber").alias("ord"), F.expr("l_quantity < 20").alias("hedging_preserved"), F.expr("l_discount > 0.02").alias("factual_additions"), F.expr("CASE l_returnflag WHEN 'R' THEN 'omission' WHEN 'A' THEN 'distortion' END").alias("mode"), F.expr("l_tax > 0.075").alias("failed")))


def node_data(c: Corpus):
    line = c.table("lineitem").join(c.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumns({"repo_id": F.expr("concat('firm_', o_custkey)"), "node": F.expr("concat('s', l_suppkey)")})
    esc = line.filter("l_linenumber > 3").select("repo_id", "node", F.expr("CASE WHEN l_quantity > 30 THEN 'escalating' ELSE 'flat' END").alias("confidence_trajectory"), F.expr("CASE l_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'unheard of' END").alias("fabrication_risk"), F.expr("l_partkey % 2 = 0").alias("compensatory_assertion"))
    return r6(L.node_semantics(line.select("repo_id", "node").distinct(), line.filter("l_returnflag = 'R'").select("repo_id", "node", F.col("l_discount").alias("stability_score")), line.filter("l_returnflag = 'A'").select("repo_id", "node", F.col("l_tax").alias("vulnerability_score")), esc))


QUERIES = [
    Query("n37_entry_points", starts, "WITH " + _ST),
    Query("n46_n48_maturity", lambda c: T.maturity_scores(repos(c), files(c), F.expr(NOW)), "WITH " + _MA),
    Query("g26_semantic_findings", findings, "WITH " + _SF + f"SELECT repo_id, finding_id, {_NM}, subject, CAST(measure AS DOUBLE) AS measure FROM fs"),
    Query("g26_drifting_edges", drifting, "WITH " + _DM),
    Query("g28_node_semantics", node_data, "WITH ln AS (SELECT concat('firm_', o_custkey) AS repo_id, concat('s', l_suppkey) AS node, * FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT repo_id, node, round(max(l_discount) FILTER (l_returnflag = 'R'), 6) AS stability_score, round(max(l_tax) FILTER (l_returnflag = 'A'), 6) AS vulnerability_score, round(avg(CAST(l_quantity > 30 AS DOUBLE)) FILTER (l_linenumber > 3), 6) AS escalation_rate, "
        "CASE max(CASE l_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 0 END) FILTER (l_linenumber > 3) WHEN 3 THEN 'high' WHEN 1 THEN 'low' WHEN 0 THEN 'none' END AS max_fabrication_risk, bool_or(l_partkey % 2 = 0) FILTER (l_linenumber > 3) AS compensatory_assertion_observed FROM ln GROUP BY ALL"),
]
