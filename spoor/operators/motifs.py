"""Structural motifs as tall tables (repo_id, motif, instance, node_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spoor.operators.graph import shortest_cycles
from spoor.session import cut

OUT = ["repo_id", "motif", "instance", "node_id"]
MOTIFS = ["shared_state_without_arbitration", "linear_delegation_chain", "hub_and_spoke", "feedback_loop", "trust_boundary_crossing"]
OUTSIDE = ["external", "mcp_server"]


def _rows(df: DataFrame, motif: str, instance, node) -> DataFrame:
    return df.select("repo_id", F.lit(motif).alias("motif"), instance.cast("string").alias("instance"), node.alias("node_id"))


def shared_state(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Data stores with two or more writers and no arbitration edge."""
    stores = nodes.filter("node_type = 'data_store'").select("repo_id", F.col("node_id").alias("store"))
    w = edges.filter("edge_type = 'writes_to'").select("repo_id", F.col("target").alias("store"), F.col("source").alias("writer")).join(stores, ["repo_id", "store"], "left_semi")
    arb = edges.filter("edge_type = 'arbitrated_by'").select("repo_id", F.explode(F.array("source", "target")).alias("store")).distinct()
    many = w.groupBy("repo_id", "store").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").join(arb, ["repo_id", "store"], "left_anti")
    hit = w.join(many.select("repo_id", "store"), ["repo_id", "store"], "left_semi")
    own = many.select("repo_id", "store", F.col("store").alias("writer"))
    return _rows(hit.select("repo_id", "store", "writer").unionByName(own), MOTIFS[0], F.col("store"), F.col("writer")).distinct()


def linear_chains(edges: DataFrame, min_nodes: int = 3) -> DataFrame:
    """From roots of the delegation graph, follow the only unvisited successor."""
    d = cut(edges.filter("edge_type = 'delegates_to' AND source <> '' AND target <> ''").select("repo_id", "source", "target"))
    roots = d.select("repo_id", F.col("source").alias("node")).distinct().join(d.select("repo_id", F.col("target").alias("node")), ["repo_id", "node"], "left_anti")
    alive = cut(roots.select("repo_id", F.col("node").alias("root"), F.array("node").alias("path")))
    done = alive.limit(0)
    while True:
        nxt = (
            alive.withColumn("source", F.element_at("path", -1)).join(d, ["repo_id", "source"]).filter(~F.array_contains("path", F.col("target")))
            .groupBy("repo_id", "root").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"), F.first("path").alias("path"))
            .filter("n = 1").select("repo_id", "root", F.array_append("path", F.col("target")).alias("path"))
        )
        nxt = cut(nxt)
        done = done.unionByName(alive.join(nxt.select("repo_id", "root"), ["repo_id", "root"], "left_anti"))
        alive = nxt
        if alive.isEmpty():
            break
    chains = done.unionByName(alive).filter(F.size("path") >= min_nodes)
    return _rows(chains.withColumn("node", F.explode("path")), MOTIFS[1], F.col("root"), F.col("node"))


def hubs(edges: DataFrame, spokes: int = 3) -> DataFrame:
    d = edges.filter("edge_type = 'delegates_to' AND source <> '' AND target <> ''")
    big = d.groupBy("repo_id", "source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= spokes)
    arms = d.join(big.select("repo_id", "source"), ["repo_id", "source"], "left_semi").select("repo_id", "source", "target")
    return _rows(arms.unionByName(big.select("repo_id", "source", F.col("source").alias("target"))), MOTIFS[2], F.col("source"), F.col("target")).distinct()


def feedback_loops(edges: DataFrame) -> DataFrame:
    rings = shortest_cycles(edges, types=["delegates_to", "feeds_into"])
    return _rows(rings.withColumn("node", F.explode("cycle")), MOTIFS[3], F.array_join("cycle", "->"), F.col("node"))


def crossings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with exactly one end outside the trust boundary."""
    kind = nodes.select("repo_id", "node_id", F.col("node_type").isin(OUTSIDE).alias("out")).filter("out")
    e = edges
    for end in ("source", "target"):
        e = e.join(kind.select("repo_id", F.col("node_id").alias(end), F.lit(True).alias(f"{end}_out")), ["repo_id", end], "left")
    return e.filter(F.col("source_out").isNotNull() != F.col("target_out").isNotNull()).drop("source_out", "target_out")


def trust_crossings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    c = crossings(nodes, edges).select("repo_id", F.explode(F.array("source", "target")).alias("node"))
    return _rows(c, MOTIFS[4], F.lit("all"), F.col("node")).distinct()


def motifs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All motif instances with the nodes they involve."""
    out = shared_state(nodes, edges)
    for df in (linear_chains(edges), hubs(edges), feedback_loops(edges), trust_crossings(nodes, edges)):
        out = out.unionByName(df)
    return out
