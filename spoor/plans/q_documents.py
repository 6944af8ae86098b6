"""Registered queries: audits of exported documents, behavioral records and report artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from spoor.operators import baselines as B
from spoor.operators import constraints as C
from spoor.operators import failure as X
from spoor.operators.actual_paths import normalized_traces, script_failure_modes
from spoor.plans.corpus import Corpus, Query
from spoor.plans.q_failure import _ACTUAL, _MET, _UNPIV, G18, actual
from spoor.plans.q_reference import RULE, scans
from spoor.session import _checkpoint_dir, land
from spoor.sources import jsonl
from spoor.sources.tables import with_ctes as W


def export_lines(c: Corpus):
    """One document per customer: orders are runs, their suppliers agents that hand over line by line; some are broken on purpose."""
    def build():
        k = F.col("o_custkey")
        nxt = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
        name = lambda col: F.concat(F.lit("s"), col.cast("string"))
        line = c.table("lineitem").withColumn("nxt", nxt).join(c.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        agent = F.struct(name(F.col("l_suppkey")).alias("agent_name"), F.array(F.struct(F.when(F.col("l_returnflag") == "N", "").otherwise("sold").alias("output_text"))).alias("tasks"))
        chain = F.when(F.col("nxt").isNotNull(), F.struct(F.when(F.col("l_orderkey") % 53 == 0, "ghost").otherwise(name(F.col("l_suppkey"))).alias("upstream_agent"), name(F.col("nxt")).alias("downstream_agent")))
        runs = line.groupBy("o_custkey", "l_orderkey").agg(F.struct(F.collect_list(agent).alias("agents"), F.collect_list(chain).alias("delegation_chains")).alias("run"))
        docs = runs.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "run"))), lambda r: r["run"]).alias("runs"))
        repo = F.when(k % 37 == 0, F.concat(F.lit("firm/"), k)).when(k % 41 == 0, "https://github.com/firm/1").otherwise(F.concat(F.lit("https://github.com/firm/"), k))
        status = F.when(k % 3 == 0, "SUCCESS").when(k % 3 == 1, "PARTIAL_SUCCESS").otherwise("FAILED")
        doc = F.to_json(F.struct(repo.alias("repo_id"), F.md5(repo).alias("repo_hash"), F.when(k % 31 > 0, "crewai").alias("framework"), status.alias("scan_status"), F.when(k % 43 == 0, F.slice("runs", 1, 0)).otherwise(F.col("runs")).alias("runs")))
        raw = F.when(k % 23 == 0, F.substring(doc, 1, 60)).when(k % 29 == 0, "[1]").otherwise(doc)
        return docs.select(k.alias("line"), raw.alias("raw"))

    return c.keep("export_documents", build)


def records(c: Corpus):
    """One behavioral record per repository with its error traces as JSON; some fields are broken by place."""
    def build():
        i = F.row_number().over(Window.partitionBy("repo_id").orderBy("run_id", "event_id")) - 1
        t = land(actual(c).withColumn("i", i), "numbered_traces")
        text = lambda col: F.concat(F.lit('"'), F.coalesce(col, F.lit("")), F.lit('"'))
        path = F.to_json(F.col("actual_path"))
        fields = [
            F.when(F.col("i") % 7 != 3, F.concat(F.lit('"error_source_node":'), text(F.col("source")))), F.concat(F.lit('"structural_predicted_path":'), path), F.concat(F.lit('"actual_observed_path":'), F.when(F.col("i") % 5 == 4, text(F.col("last_node"))).otherwise(path)),
            F.concat(F.lit('"stop_mechanism":'), F.when(F.col("i") % 9 == 8, F.lit("7")).otherwise(text(F.col("stop_mechanism")))),
            F.concat(F.lit('"downstream_impact":{"nodes_affected":'), F.size("actual_path").cast("string"), F.lit(',"downstream_errors":'), F.col("later_errors").cast("string"), F.lit(',"downstream_tasks_failed":0'), F.when(F.col("i") % 6 == 5, "").otherwise(',"cascade_depth":1'), F.lit("}")),
        ]
        one = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
        all_ = t.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", one.alias("j")))), lambda x: x["j"]), ",").alias("traces"))
        head = '"repo_full_name":"r","schema_version":"v6","execution_metadata":{},"edge_validation":{},"emergent_edges":[],"node_activation":{},"monitoring_baselines":[]'
        modes = F.when(F.substring("repo_id", -1, 1) == "5", "").otherwise(',"failure_modes":[]')
        return all_.select("repo_id", F.concat(F.lit("{" + head), modes, F.lit(',"error_propagation":['), "traces", F.lit("]}")).alias("raw"))

    return c.keep("record_documents", build)


def normalized(c: Corpus):
    t = records(c).withColumn("doc", F.try_parse_json("raw")).select("repo_id", F.posexplode(F.try_variant_get("doc", "$.error_propagation", "array<variant>")).alias("at", "t"))
    n = normalized_traces(t)
    return n.select("repo_id", "at", "error_source_node", "stop_mechanism", F.array_join("structural_predicted_path", "->").alias("predicted"), F.array_join("actual_observed_path", "->").alias("observed"), "nodes_affected", "cascade_depth")


def trace_folder(c: Corpus) -> str:
    """The corpus events as a folder of JSON lines; some lines are cut short, some name their tokens otherwise."""
    if "trace_folder" not in c._kept:
        path = f"{_checkpoint_dir(c.spark)}/traces/{uuid.uuid4().hex}"
        n = F.col("event_id").cast("long")
        doc = F.to_json(F.struct(*c.events.columns))
        doc = F.when(n % 97 == 0, F.substring(doc, 1, 30)).when(n % 3 == 0, F.replace(F.replace(doc, F.lit('"input_tokens"'), F.lit('"prompt_tokens"')), F.lit('"output_tokens"'), F.lit('"completion_tokens"'))).otherwise(doc)
        c.events.select(doc.alias("value")).write.text(path)
        c._kept["trace_folder"] = c.spark.createDataFrame([(path,)], "path string")
    return c._kept["trace_folder"].first()["path"]


def read_back(c: Corpus):
    good, bad = jsonl.read_events(c.spark, trace_folder(c), "*.txt")
    counted = good.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("payload.input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("payload.output_tokens"), F.lit(0)).alias("output_tokens"))
    return counted.unionByName(bad.agg(F.lit("(quarantined)").alias("event_type"), F.count(F.lit(1)).alias("events"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens")))


def artifacts(c: Corpus):
    rules = scans(c).select(F.explode("finding_rules").alias("finding_id")).distinct().withColumn("finding_name", F.col("finding_id"))
    found = script_failure_modes(X.run_signals(c.events)).select("finding_id", "finding_name").distinct()
    base = B.baselines(B.run_metrics(c.events)).select("repo_id", "finding_id", "metric")
    reports = c.events.groupBy("repo_id").agg(F.when(F.count_distinct("run_id") > 3, "v6").otherwise("v5").alias("schema_version"))
    return C.artifact_summary(rules.unionByName(found), base, reports, 20)


_EXP = (
    "xl AS (SELECT *, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem), "
    "xd AS MATERIALIZED (SELECT o_custkey AS line, bool_or(l_returnflag <> 'N') AS told, CASE WHEN o_custkey % 37 = 0 THEN 'firm/' || o_custkey WHEN o_custkey % 41 = 0 THEN 'https://github.com/firm/1' ELSE 'https://github.com/firm/' || o_custkey END AS repo, "
    "o_custkey % 23 > 0 AS valid, o_custkey % 23 > 0 AND o_custkey % 29 > 0 AS obj FROM xl JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) "
)

QUERIES = [
    Query("a2_events_of_a_folder", read_back, W(
        "SELECT event_type, count(*) AS events, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM ev WHERE event_id % 97 > 0 GROUP BY 1 "
        "UNION ALL SELECT '(quarantined)', count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ev WHERE event_id % 97 = 0", "ev")),
    Query("a10_export_violations", lambda c: C.export_violations(export_lines(c))[0], "WITH " + _EXP + (
        "SELECT 'export' AS \"table\", rule, CAST(line AS VARCHAR) AS key, detail FROM (SELECT line, 'invalid_json' AS rule, '' AS detail FROM xd WHERE NOT valid UNION ALL SELECT line, 'not_an_object', '' FROM xd WHERE valid AND NOT obj "
        "UNION ALL SELECT line, 'missing_field', 'framework' FROM xd WHERE obj AND line % 31 = 0 UNION ALL SELECT line, 'not_a_github_url', repo FROM xd WHERE obj AND line % 37 = 0 UNION ALL SELECT line, 'no_runs', repo FROM xd WHERE obj AND line % 43 = 0 "
        "UNION ALL SELECT line, 'no_output', repo FROM xd WHERE obj AND line % 43 > 0 AND NOT told UNION ALL (SELECT line, 'duplicate_repo_id', repo FROM xd WHERE obj QUALIFY row_number() OVER (PARTITION BY repo ORDER BY line) > 1) "
        "UNION ALL SELECT line, 'unknown_upstream', 'ghost' FROM xd JOIN orders ON o_custkey = line JOIN xl ON l_orderkey = o_orderkey WHERE obj AND line % 43 > 0 AND nxt IS NOT NULL AND l_orderkey % 53 = 0)")),
    Query("a11_record_violations", lambda c: C.record_violations(records(c)), W(
        "WITH " + _ACTUAL + "ix AS (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY run_id, eid) - 1 AS i FROM pa) "
        "SELECT 'record' AS \"table\", rule, repo_id AS key, detail FROM (SELECT DISTINCT repo_id, 'missing_section' AS rule, 'failure_modes' AS detail FROM ix WHERE right(repo_id, 1) = '5' UNION ALL SELECT repo_id, 'trace_without_source', '[' || i || ']' FROM ix WHERE i % 7 = 3 "
        "UNION ALL SELECT repo_id, 'observed_path_no_list', '[' || i || ']' FROM ix WHERE i % 5 = 4 UNION ALL SELECT repo_id, 'stop_mechanism_no_text', '[' || i || ']' FROM ix WHERE i % 9 = 8 UNION ALL SELECT repo_id, 'impact_counter_missing', '[' || i || '].cascade_depth' FROM ix WHERE i % 6 = 5)", "ev")),
    Query("g34_normalized_traces", normalized, W(
        "WITH " + _ACTUAL + "ix AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY run_id, eid) - 1 AS i FROM atr) SELECT repo_id, CAST(i AS INTEGER) AS at, CASE WHEN i % 7 = 3 THEN '' ELSE coalesce(source, '') END AS error_source_node, CASE WHEN i % 9 = 8 THEN '7' ELSE stop_mechanism END AS stop_mechanism, array_to_string(path, '->') AS predicted, "
        "CASE WHEN i % 5 = 4 THEN '' ELSE array_to_string(path, '->') END AS observed, len(path) AS nodes_affected, CASE WHEN i % 6 = 5 THEN CAST(0 AS BIGINT) ELSE 1 END AS cascade_depth FROM ix", "ev")),
    Query("a23_artifact_checks", artifacts, W(
        "WITH " + _MET + _UNPIV + f"ru AS (SELECT DISTINCT {RULE} AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), "
        f"sf AS (SELECT DISTINCT finding_id FROM ({G18})), rv AS (SELECT repo_id, count(DISTINCT run_id) AS n FROM ev GROUP BY 1), "
        "re AS (SELECT count(*) AS n, count(*) FILTER (n <= 3) AS old FROM rv), ba AS (SELECT DISTINCT repo_id, metric FROM lg WHERE v IS NOT NULL) "
        "SELECT 'catalog' AS artifact, 'rows' AS rule, (SELECT count(*) FROM ru WHERE f IS NOT NULL) + (SELECT count(*) FROM sf) AS broken UNION ALL SELECT 'catalog', 'id_prefix', count(*) FROM ru WHERE f NOT LIKE 'STRAT-%' UNION ALL SELECT 'baselines', 'rows', count(*) FROM ba "
        "UNION ALL SELECT 'reports', 'rows', n FROM re UNION ALL SELECT 'reports', 'schema_version', old FROM re WHERE old > 0 UNION ALL SELECT 'reports', 'too_few', CAST(n < 20 AS BIGINT) FROM re", "evl", "ev")),
]
