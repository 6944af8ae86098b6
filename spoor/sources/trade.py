"""Larger agent graphs read out of orders: one graph per customer, tens to hundreds of nodes.

Suppliers are agents, parts capabilities. Within an order, one line's supplier hands over to the next
line's; quantity, flags, discount and tax decide what else a line connects. The rules below are SQL text
that Spark and the checking engine both accept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spoor.sources.tables import table

AGENT, NEXT, CAP, STORE = ("agent_s", "l_suppkey"), ("agent_s", "next_supp"), ("cap_p", "l_partkey"), ("ds_", "l_partkey % 11")
# (edge type, condition on the line, whether it must lead to another supplier, source, target) of one order line; an end is
# a prefix and a value; `next_supp` is the supplier of the order's next line
LINE_EDGES = [
    ("delegates_to", "l_quantity >= 40", True, AGENT, NEXT),
    ("feeds_into", "l_quantity >= 34 AND l_quantity < 40", True, AGENT, NEXT),
    ("uses", "true", False, AGENT, CAP),
    ("writes_to", "l_returnflag = 'R' AND l_quantity > 35", False, AGENT, STORE),
    ("reads_from", "l_returnflag = 'N' AND l_quantity > 45", False, AGENT, STORE),
    ("calls", "l_discount > 0.085 AND l_tax > 0.065 AND l_quantity < 12", False, AGENT, ("ext_", "l_linestatus")),
    ("filtered_by", "l_tax > 0.075 AND l_quantity < 20", False, CAP, ("guard_", "o_orderstatus")),
    ("arbitrated_by", "l_returnflag = 'R' AND l_tax < 0.005", False, STORE, AGENT),
]
ONWARD = "next_supp <> l_suppkey"
_PREFIX = {"agent": "agent_", "capability": "cap_", "data_store": "ds_", "external": "ext_"}
REPO = "concat('firm_', o_custkey)"
FRAMEWORK = "CASE o_custkey % 3 WHEN 0 THEN 'crewai' WHEN 1 THEN 'langgraph' ELSE 'autogen' END"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the next supplier and `kinds`: the edge types a line's own columns allow, as places in LINE_EDGES.

    The numbers that decide are read before the rows are shuffled and stay behind.
    """
    from pyspark.sql import Window as W

    kinds = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(i).cast("byte")) for i, (_, cond, *_) in enumerate(LINE_EDGES)])).alias("kinds")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", kinds)
    line = line.withColumn("next_supp", F.lead("l_suppkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    return line.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))


def edge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, kind, source_key, target_key): every edge once, as its place in LINE_EDGES and the values of its ends."""
    lines = _lines(spark, sf_dir).withColumn("kind", F.explode("kinds"))
    onward = [i for i, e in enumerate(LINE_EDGES) if e[2]]
    lines = lines.filter(~F.col("kind").isin(onward) | F.expr(ONWARD))

    def value(end: int) -> Column:
        out = None
        for text in dict.fromkeys(e[end][1] for e in LINE_EDGES):
            hit = F.col("kind").isin([i for i, e in enumerate(LINE_EDGES) if e[end][1] == text])
            out = F.when(hit, F.expr(text).cast("string")) if out is None else out.when(hit, F.expr(text).cast("string"))
        return out

    return lines.select("o_custkey", "kind", value(3).alias("source_key"), value(4).alias("target_key")).distinct()


def _at_kind(values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.col("kind"))


def trade_edges(keys: DataFrame) -> DataFrame:
    """edges(repo_id, framework, edge_id, source, target, edge_type) of `edge_keys`, spelled out row by row."""
    rows = keys.select(
        F.expr(REPO).alias("repo_id"), F.expr(FRAMEWORK).alias("framework"), F.concat(_at_kind([e[3][0] for e in LINE_EDGES]), "source_key").alias("source"),
        F.concat(_at_kind([e[4][0] for e in LINE_EDGES]), "target_key").alias("target"), _at_kind([e[0] for e in LINE_EDGES]).alias("edge_type"))
    return rows.withColumn("edge_id", F.concat_ws("|", "edge_type", "source", "target"))


def node_keys(keys: DataFrame) -> DataFrame:
    """(o_custkey, prefix, key): the ends of all edges of `edge_keys`, each once; ends without a value are one."""
    ends = F.array(*[F.struct(F.when(F.col(name).isNotNull(), _at_kind([e[end][0] for e in LINE_EDGES])).alias("prefix"), F.col(name).alias("key")) for end, name in ((3, "source_key"), (4, "target_key"))])
    return keys.select("o_custkey", F.inline(ends)).distinct()


def trade_nodes(keys: DataFrame) -> DataFrame:
    """nodes(repo_id, framework, node_id, node_type, name) of `node_keys`, spelled out row by row."""
    nodes = keys.select(F.expr(REPO).alias("repo_id"), F.expr(FRAMEWORK).alias("framework"), F.concat("prefix", "key").alias("node_id"))
    kind = F.lit("guardrail")
    for t, p in _PREFIX.items():
        kind = F.when(F.col("node_id").startswith(p), t).otherwise(kind)
    return nodes.withColumn("node_type", kind).withColumn("name", F.col("node_id"))


def sql_trade() -> str:
    """CTEs tnodes and tedges for the checking engine, ending in a comma."""
    end = lambda e: f"concat('{e[0]}', {e[1]})"
    arms = " UNION ALL ".join(f"SELECT repo_id, framework, {end(a)} AS source, {end(b)} AS target, '{kind}' AS edge_type FROM tlines WHERE {cond}{f' AND {ONWARD}' * onward}" for kind, cond, onward, a, b in LINE_EDGES)
    kind = "CASE " + " ".join(f"WHEN starts_with(node_id, '{p}') THEN '{t}'" for t, p in _PREFIX.items()) + " ELSE 'guardrail' END"
    return (
        f"tlines AS (SELECT *, {REPO} AS repo_id, {FRAMEWORK} AS framework FROM (SELECT *, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS next_supp FROM lineitem) JOIN orders ON l_orderkey = o_orderkey), "
        f"tedges AS MATERIALIZED (SELECT DISTINCT *, edge_type || '|' || source || '|' || target AS edge_id FROM ({arms})), "
        f"tnodes AS MATERIALIZED (SELECT *, {kind} AS node_type, node_id AS name FROM (SELECT DISTINCT repo_id, framework, unnest([source, target]) AS node_id FROM tedges)), "
    )
