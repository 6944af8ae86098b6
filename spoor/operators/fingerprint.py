"""Structural fingerprints of graphs and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spoor.functions.stats import bool_or, count_if, ratio
from spoor.functions.text import contains_any
from spoor.operators import graph as G
from spoor.operators import motifs as M
from spoor.operators.knowledge import delegation_roots

# fixed values: edge types by what they mean for the fingerprint
CAPABILITY_EDGES = ["calls", "tool_of", "delegates_to", "feeds_into", "reads_from", "writes_to", "sends_to", "shares_with"]
GUARDRAIL_EDGES = ["filtered_by", "gated_by"]
OBSERVABILITY_EDGES = ["filtered_by", "gated_by", "feeds_into"]
IRREVERSIBLE_EDGES = ["writes_to", "sends_to", "calls"]
FEATURES = [
    "agent_count", "capability_count", "data_store_count", "external_count", "guardrail_count", "total_edges", "delegation_depth_max", "delegation_depth_mean", "control_coverage_ratio",
    "observability_coverage_ratio", "shared_state_writer_count", "trust_boundary_crossing_count", "feedback_loop_count", "hub_spoke_ratio", "betweenness_max", "betweenness_mean",
    "error_propagation_path_count", "irreversible_capability_count", "agent_to_capability_ratio", "has_human_checkpoint",
]
BLOCK_QUERIES = 1000
# fixed values: the dimensions of the short vector that matching compares
MATCH_FEATURES = [
    "agent_count", "capability_count", "data_store_count", "external_count", "edge_count", "delegation_depth", "has_shared_state_without_arbitration", "has_linear_delegation_chain",
    "has_hub_and_spoke", "has_feedback_loop", "has_trust_boundary_crossing", "guardrail_count", "mcp_server_count",
]


def type_counts(nodes: DataFrame) -> DataFrame:
    t = F.col("node_type")
    return nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("nodes"), *[count_if(t == k).alias(f"{k}_count") for k in ("agent", "capability", "data_store", "external", "guardrail")])


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Share of each value per repository (node types, edge types)."""
    n = df.groupBy("repo_id", column).agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy("repo_id").agg(F.sum("n").alias("t")), "repo_id").select("repo_id", column, "n", (F.col("n") / F.col("t")).alias("share"))


def shared_writers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    stores = nodes.filter("node_type = 'data_store'").select("repo_id", F.col("node_id").alias("target"))
    w = edges.filter("edge_type = 'writes_to' AND source <> ''").join(stores, ["repo_id", "target"], "left_semi").select("repo_id", "target", "source").distinct()
    return w.groupBy("repo_id", "target").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy("repo_id").agg(F.sum("n").alias("shared_state_writer_count"))


def irreversible(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct capabilities (agents where a graph has no capability) with an irreversible edge."""
    acts = edges.filter(F.col("edge_type").isin(IRREVERSIBLE_EDGES)).select("repo_id", F.col("source").alias("node_id")).distinct().join(nodes.select("repo_id", "node_id", "node_type"), ["repo_id", "node_id"])
    has = nodes.groupBy("repo_id").agg(bool_or(F.col("node_type") == "capability").alias("caps"))
    return acts.join(has, "repo_id").filter(F.when(F.col("caps"), F.col("node_type") == "capability").otherwise(F.col("node_type") == "agent")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("irreversible_capability_count"))


def human_checkpoint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    name, kind = F.lower(F.coalesce("name", F.lit(""))), F.lower("node_type")
    own = kind.contains("human") | name.contains("human") | ((kind == "guardrail") & contains_any(name, ["approval", "review", "confirm", "checkpoint"]))
    gates = edges.filter("edge_type = 'gated_by'").select("repo_id", F.col("target").alias("node_id")).distinct().withColumn("gate", F.lit(True))
    j = nodes.join(gates, ["repo_id", "node_id"], "left")
    return j.groupBy("repo_id").agg(bool_or(own | (F.col("gate") & contains_any(name, ["human", "approval", "review", "confirm"]))).cast("int").alias("has_human_checkpoint"))


def delegation_depths(edges: DataFrame) -> DataFrame:
    """(repo_id, root, depth): levels below each delegation root, the root counting as one."""
    lv = G.closest_levels(edges, delegation_roots(edges), types=["delegates_to"])
    return lv.groupBy("repo_id", "root").agg((F.max("depth") + 1).alias("depth"))


def error_paths(nodes: DataFrame, edges: DataFrame, far: DataFrame) -> DataFrame:
    """Pairs of a node beside an external service and an irreversible sink it reaches."""
    out = nodes.filter(F.col("node_type").isin(M.OUTSIDE)).select("repo_id", "node_id")
    c = M.crossings(nodes, edges).select("repo_id", F.explode(F.array("source", "target")).alias("node_id")).distinct().join(out, ["repo_id", "node_id"], "left_anti")
    sinks = edges.filter(F.col("edge_type").isin(IRREVERSIBLE_EDGES)).select("repo_id", F.col("source").alias("node")).distinct()
    hit = far.join(c.withColumnRenamed("node_id", "origin"), ["repo_id", "origin"], "left_semi").join(sinks, ["repo_id", "node"], "left_semi")
    return hit.groupBy("repo_id").agg(F.count(F.lit(1)).alias("error_propagation_path_count"))


def topology_hash(edges: DataFrame) -> DataFrame:
    """SHA-256 of the sorted (source, target, type) list as compact JSON; one graph document per value."""
    t = F.array_sort(F.collect_list(F.array("source", "target", "edge_type")))
    return edges.groupBy("repo_id").agg(F.sha2(F.to_json(t), 256).alias("topology_hash"))


def fingerprints(nodes: DataFrame, edges: DataFrame, far: DataFrame) -> DataFrame:
    """repo_id, the twenty features as columns, and feature_vector."""
    t = F.col("edge_type")
    e = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_edges"), count_if(t.isin(CAPABILITY_EDGES)).alias("_cap"), count_if(t.isin(GUARDRAIL_EDGES)).alias("_guard"))
    seen = edges.filter(t.isin(OBSERVABILITY_EDGES)).select("repo_id", F.explode(F.array("source", "target")).alias("node_id")).distinct().withColumn("_o", F.lit(True))
    ac = nodes.filter(F.col("node_type").isin("agent", "capability")).join(seen, ["repo_id", "node_id"], "left").groupBy("repo_id").agg(F.avg(F.col("_o").isNotNull().cast("int")).alias("observability_coverage_ratio"))
    depth = delegation_depths(edges).groupBy("repo_id").agg(F.max("depth").alias("delegation_depth_max"), F.avg("depth").alias("delegation_depth_mean"))
    cross = M.crossings(nodes, edges).groupBy("repo_id").agg(F.count(F.lit(1)).alias("trust_boundary_crossing_count"))
    loops = G.shortest_cycles(edges).groupBy("repo_id").agg(F.count(F.lit(1)).alias("feedback_loop_count"))
    deg = G.degrees(nodes, edges).withColumn("d", F.col("out_degree") + F.col("in_degree")).groupBy("repo_id").agg(F.max("d").alias("_dmax"), F.avg("d").alias("_davg"))
    bc = G.betweenness(nodes, edges).groupBy("repo_id").agg(F.max("betweenness").alias("betweenness_max"), F.avg("betweenness").alias("betweenness_mean"))
    out = type_counts(nodes)
    for df in (e, ac, depth, shared_writers(nodes, edges), cross, loops, deg, bc, error_paths(nodes, edges, far), irreversible(nodes, edges), human_checkpoint(nodes, edges)):
        out = out.join(df, "repo_id", "left")
    out = out.fillna(0)
    out = out.withColumn("control_coverage_ratio", F.when(F.col("_cap") > 0, F.col("_guard") / F.col("_cap")).otherwise(0.0))
    out = out.withColumn("hub_spoke_ratio", F.when(F.col("_davg") > 0, F.col("_dmax") / F.col("_davg")).otherwise(0.0))
    out = out.withColumn("agent_to_capability_ratio", F.when(F.col("capability_count") > 0, F.col("agent_count") / F.col("capability_count")).otherwise(0.0))
    vals = [F.col(f).cast("double").alias(f) for f in FEATURES]
    return out.select("repo_id", *vals, F.array(*vals).alias("feature_vector"))


def normalization(fps: DataFrame, vector: str = "feature_vector") -> DataFrame:
    """(pos, lo, hi) of each vector position over the corpus."""
    return fps.select(F.posexplode(vector).alias("pos", "v")).groupBy("pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def normalized(fps: DataFrame, norm: DataFrame, vector: str = "feature_vector", *, clip: bool = True) -> DataFrame:
    """Min-max scaled vectors; vectors of another length stay as they are."""
    k = norm.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))).alias("_k"))  # one small row

    def scale(v: Column, b: Column) -> Column:
        s = F.when(b["hi"] - b["lo"] == 0, 0.0).otherwise((v - b["lo"]) / (b["hi"] - b["lo"]))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)) if clip else s

    j = fps.join(F.broadcast(k))
    same = F.size(vector) == F.size("_k")
    return j.withColumn("normalized", F.when(same, F.zip_with(vector, "_k", scale)).otherwise(F.col(vector))).drop("_k")


def dot(a: Column, b: Column) -> Column:
    """Dot product; the shorter vector counts as zero-padded."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def nearest(queries: DataFrame, base: DataFrame, *, k: int, floor: float | None = None) -> DataFrame:
    """Exact top-k of base(id, vec) for each of queries(query_id, qvec) by cosine.

    The query side is counted and taken in blocks of about BLOCK_QUERIES, each one broadcast row.
    The base is read once per block, scores stay on the map side, and each task keeps only its own best k
    per query before the shuffle (rank limit below the exchange).
    """
    q = queries.select("query_id", "qvec")
    blocks = max(1, -(-q.count() // BLOCK_QUERIES))
    scored = None
    for block in range(blocks):
        some = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        pack = some.agg(F.collect_list(F.struct("query_id", "qvec")).alias("_q"))  # one row of about BLOCK_QUERIES vectors
        part = base.join(F.broadcast(pack)).select("id", "vec", F.explode("_q").alias("q")).select(F.col("q.query_id").alias("query_id"), "id", cosine(F.col("vec"), F.col("q.qvec")).alias("similarity"))
        part = part if floor is None else part.filter(F.col("similarity") >= floor)
        scored = part if scored is None else scored.unionByName(part)
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def motif_flags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, motif, size): motifs a graph shows, with the nodes of its largest instance; loops are found without listing them."""
    out = G.cyclic_repos(edges, ["delegates_to", "feeds_into"]).select("repo_id", F.lit(M.MOTIFS[3]).alias("motif"), F.lit(None).cast("long").alias("size"))
    for df in (M.shared_state(nodes, edges), M.linear_chains(edges), M.hubs(edges), M.trust_crossings(nodes, edges)):
        sized = df.groupBy("repo_id", "motif", "instance").agg(F.count(F.lit(1)).alias("size"))
        out = out.unionByName(sized.groupBy("repo_id", "motif").agg(F.max("size").alias("size")))
    return out


def match_features(nodes: DataFrame, edges: DataFrame, flags: DataFrame) -> DataFrame:
    """(repo_id, the MATCH_FEATURES, feature_vector): counts by type, longest delegation chain, motif marks."""
    kinds = ("agent", "capability", "data_store", "external", "guardrail", "mcp_server")
    counts = nodes.groupBy("repo_id").agg(*[count_if(F.col("node_type") == k).alias(f"{k}_count") for k in kinds])
    n_edges = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edge_count"))
    marks = flags.groupBy("repo_id").agg(*[F.max((F.col("motif") == m).cast("int")).alias(f"has_{m}") for m in M.MOTIFS], F.max(F.when(F.col("motif") == M.MOTIFS[1], F.col("size"))).alias("delegation_depth"))
    out = counts.join(n_edges, "repo_id", "left").join(marks, "repo_id", "left").fillna(0)
    vals = [F.col(f).cast("double").alias(f) for f in MATCH_FEATURES]
    return out.select("repo_id", *vals, F.array(*vals).alias("feature_vector"))


# ---- archetypes -----------------------------------------------------------------
def repo_motifs(motif_nodes: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo_id, motifs): sorted distinct motif names, empty for plain graphs."""
    m = motif_nodes.select("repo_id", "motif").distinct().groupBy("repo_id").agg(F.sort_array(F.collect_set("motif")).alias("motifs"))
    return repos.select("repo_id").distinct().join(m, "repo_id", "left").withColumn("motifs", F.coalesce("motifs", F.array().cast("array<string>")))


def archetype(motifs: Column, agents: Column) -> Column:
    """Topology family by motif rules, combined motifs first."""
    has = lambda m: F.array_contains(motifs, m)
    return (
        F.when(has("linear_delegation_chain") & has("shared_state_without_arbitration"), "hierarchical_delegation").when(has("hub_and_spoke") & has("shared_state_without_arbitration"), "hub_and_spoke_shared_state")
        .when(has("hub_and_spoke"), "hub_and_spoke").when(has("linear_delegation_chain"), "linear_pipeline").when(has("feedback_loop"), "feedback_loop_system")
        .when(has("shared_state_without_arbitration"), "shared_state_system").when(has("trust_boundary_crossing"), "trust_boundary_system").when(agents <= 1, "simple_agent").otherwise("generic"))


def with_nearest_archetype(classified: DataFrame, vectors: DataFrame, known: DataFrame, known_vectors: DataFrame, *, floor: float = 0.5) -> DataFrame:
    """`classified` where no rule fits ('generic') takes the archetype of the most similar known graph that has one.

    vectors and known_vectors are (repo_id, vec); the similarity must be above `floor`, ties go to the first repo_id.
    """
    from spoor.operators.similarity import top_similar

    base = known.filter("archetype <> 'generic'").select("repo_id").join(known_vectors, "repo_id").select(F.col("repo_id").alias("id"), "vec")
    lost = classified.filter("archetype = 'generic'").select("repo_id").join(vectors, "repo_id").select(F.col("repo_id").alias("query_id"), F.col("vec").alias("qvec"))
    near = top_similar(lost, base, k=1, floor=floor).filter(F.col("similarity") > floor)
    near = near.join(known.select(F.col("repo_id").alias("id"), F.col("archetype").alias("nearest")), "id").select(F.col("query_id").alias("repo_id"), "nearest", "similarity")
    out = classified.join(near, "repo_id", "left")
    return out.withColumn("archetype", F.coalesce("nearest", "archetype")).withColumn("by_rule", F.col("nearest").isNull()).drop("nearest")


def archetype_prevalence(classified: DataFrame) -> DataFrame:
    n = classified.groupBy("archetype").agg(F.count(F.lit(1)).alias("repos"))
    return n.join(F.broadcast(n.agg(F.sum("repos").alias("t")))).select("archetype", "repos", ratio(F.col("repos"), F.col("t")).alias("prevalence"))
