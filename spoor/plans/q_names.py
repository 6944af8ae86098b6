"""Registered queries: names, graph measures and findings that come from the rows of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.constants import FINDING_REGULATIONS, PRECONDITION_FINDING, REGULATION_REQUIREMENTS
from spoor.functions import text as T
from spoor.operators import audit as A
from spoor.operators import feedback as K
from spoor.operators import fingerprint as I
from spoor.operators import graph as G
from spoor.operators import resolve as D
from spoor.plans.corpus import Corpus, Query, r6
from spoor.plans.q_overlay import s_norm
from spoor.plans.q_triage import _SF, findings
from spoor.sources.tables import with_ctes as W
from spoor.sources.trade import sql_trade

# what is named: id, name, class and line from three tables
_NAMED = "SELECT concat('part_', p_partkey) AS id, concat(p_name, ' (', p_type, ')') AS name, concat('XMLPart', p_brand) AS class, p_size AS line FROM part UNION ALL SELECT concat('supp_', s_suppkey), s_name, concat('Supp', s_nationkey, 'Agent'), s_nationkey FROM supplier UNION ALL SELECT concat('cust_', c_custkey), concat(c_name, '-', c_mktsegment), 'CustomerDB', c_nationkey FROM customer"


def named(c: Corpus):
    t = c.table
    part = t("part").select(F.expr("concat('part_', p_partkey)").alias("id"), F.expr("concat(p_name, ' (', p_type, ')')").alias("name"), F.expr("concat('XMLPart', p_brand)").alias("class"), F.col("p_size").alias("line"))
    supp = t("supplier").select(F.expr("concat('supp_', s_suppkey)").alias("id"), F.col("s_name").alias("name"), F.expr("concat('Supp', s_nationkey, 'Agent')").alias("class"), F.col("s_nationkey").alias("line"))
    cust = t("customer").select(F.expr("concat('cust_', c_custkey)").alias("id"), F.expr("concat(c_name, '-', c_mktsegment)").alias("name"), F.lit("CustomerDB").alias("class"), F.col("c_nationkey").alias("line"))
    return part.unionByName(supp).unionByName(cust)


def table_names(c: Corpus):
    name, cls = F.col("name"), F.col("class")
    return named(c).select("id", T.normalize_name(name).alias("norm_name"), T.normalize_name(cls).alias("norm_class"), T.agent_id(cls).alias("agent_key"), T.capability_id(cls, F.lit("tool")).alias("cap_key"), T.data_store_id(name).alias("ds_key"), T.external_id(name).alias("ext_key"), T.runtime_id(F.lit("crewai"), cls, F.lit("a.py"), F.col("line")).alias("run_key"))


def supplier_lookup(c: Corpus):
    nodes = c.table("supplier").select(F.expr("concat('org_', s_nationkey)").alias("repo_id"), F.col("s_suppkey").alias("node_ord"), F.expr("concat('agent_s', s_suppkey)").alias("node_id"), F.expr("concat('agent_s', s_suppkey % 7)").alias("name"))
    return D.name_to_id(nodes)


def regulated(c: Corpus):
    r = A.regulations(findings(c).select("repo_id", "finding_id").distinct())
    return r.select("repo_id", "finding_id", F.array_join("frameworks", ",").alias("frameworks"), F.array_join("requirements", ",").alias("requirements"))


_FR = "translate(lower(name), ' ()', '_')"
_TR = "WITH " + sql_trade()
_REG = ", ".join("('{}', '{}', '{}')".format(f, r, q.replace("'", "''")) for f, rs in FINDING_REGULATIONS.items() for r in rs for q in REGULATION_REQUIREMENTS[r])

QUERIES = [
    Query("d1_table_names", table_names, f"WITH nm AS ({_NAMED}) SELECT id, {s_norm('name')} AS norm_name, {s_norm('class')} AS norm_class, 'agent_' || {s_norm('class')} AS agent_key, 'cap_' || class || '_tool' AS cap_key, 'ds_' || {_FR} AS ds_key, 'ext_' || {_FR} AS ext_key, 'crewai:' || class || ':a.py:' || line AS run_key FROM nm"),
    Query("d13_supplier_lookup", supplier_lookup, "WITH n AS (SELECT concat('org_', s_nationkey) AS repo_id, s_suppkey AS o, concat('agent_s', s_suppkey) AS node_id, concat('agent_s', s_suppkey % 7) AS name FROM supplier) SELECT repo_id, ref, arg_max(node_id, o) AS node_id FROM (SELECT repo_id, o, node_id, node_id AS ref FROM n UNION ALL SELECT repo_id, o, node_id, name FROM n) GROUP BY ALL"),
    Query("i4_trade_type_shares", lambda c: r6(I.distribution(c.trade_nodes, "node_type")), _TR + "n AS (SELECT repo_id, node_type, count(*) AS n FROM tnodes GROUP BY ALL) SELECT repo_id, node_type, n, round(n / sum(n) OVER (PARTITION BY repo_id), 6) AS share FROM n"),
    Query("i5_trade_edge_shares", lambda c: r6(I.distribution(c.trade_edges, "edge_type")), _TR + "n AS (SELECT repo_id, edge_type, count(*) AS n FROM tedges GROUP BY ALL) SELECT repo_id, edge_type, n, round(n / sum(n) OVER (PARTITION BY repo_id), 6) AS share FROM n"),
    Query("i6_trade_shared_writers", lambda c: I.shared_writers(c.trade_nodes, c.trade_edges), _TR + "w AS (SELECT repo_id, target, count(DISTINCT source) AS k FROM tedges WHERE edge_type = 'writes_to' GROUP BY ALL HAVING k >= 2) SELECT repo_id, CAST(sum(k) AS BIGINT) AS shared_state_writer_count FROM w GROUP BY 1"),
    Query("i12_trade_degrees", lambda c: G.degrees(c.trade_nodes, c.trade_edges), _TR + "o AS (SELECT repo_id, source AS node_id, count(*) AS k FROM tedges GROUP BY ALL), i AS (SELECT repo_id, target AS node_id, count(*) AS k FROM tedges GROUP BY ALL) SELECT n.repo_id, n.node_id, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) AS in_degree FROM tnodes n LEFT JOIN o USING (repo_id, node_id) LEFT JOIN i USING (repo_id, node_id)"),
    Query("h21_trade_longest_paths", lambda c: G.longest_path(c.trade_edges, types=["delegates_to"]), "WITH RECURSIVE " + sql_trade() + (
        "d AS MATERIALIZED (SELECT DISTINCT repo_id, source, target FROM tedges WHERE edge_type = 'delegates_to'), w AS (SELECT DISTINCT repo_id, [source] AS path FROM d UNION ALL SELECT w.repo_id, list_append(path, target) FROM w JOIN d ON d.repo_id = w.repo_id AND d.source = w.path[-1] AND NOT list_contains(w.path, d.target)) "
        "SELECT repo_id, CAST(max(len(path)) AS INTEGER) AS nodes FROM w GROUP BY 1")),
    Query("o3_finding_repos", lambda c: c.preconditions.groupBy(K.finding_id(F.col("precondition")).alias("finding_id")).agg(F.count_distinct("repo_id").alias("repos")), W(
        "WITH m AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{f}')" for p, f in PRECONDITION_FINDING.items()) + ") AS z(precondition, f)) SELECT coalesce(f, precondition) AS finding_id, count(DISTINCT repo_id) AS repos FROM pre LEFT JOIN m USING (precondition) GROUP BY 1", "pre")),
    Query("k24_semantic_regulations", regulated, "WITH " + _SF + f", m AS (SELECT * FROM (VALUES {_REG}) AS z(finding_id, fw, rq)) SELECT repo_id, finding_id, coalesce(string_agg(DISTINCT fw, ',' ORDER BY fw), '') AS frameworks, coalesce(string_agg(DISTINCT rq, ',' ORDER BY rq), '') AS requirements FROM (SELECT DISTINCT repo_id, finding_id FROM fs) LEFT JOIN m USING (finding_id) GROUP BY ALL"),
]
