"""Permission blast radius and privacy exposure of agent graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spoor.constants import DATA_DOMAINS, TOOL_PERMISSIONS
from spoor.functions.stats import count_if, ratio
from spoor.functions.text import keyword_classes, nz

NODE = ["repo_id", "node_id"]


def tool_permissions(tool) -> F.Column:
    return keyword_classes(tool, TOOL_PERMISSIONS, "read_data")


def data_domains(text) -> F.Column:
    return keyword_classes(text, DATA_DOMAINS, "generic")


def tools_used(events: DataFrame, types: list[str]) -> DataFrame:
    """(repo_id, node_id, tool): distinct tools per source node (events with resolved ids)."""
    t = nz(F.col("payload.tool_name"))
    return events.filter(F.col("event_type").isin(types) & t.isNotNull() & nz(F.col("source_node.node_id")).isNotNull()).select("repo_id", F.col("source_node.node_id").alias("node_id"), t.alias("tool")).distinct()


def _per_node(df: DataFrame, classes, name: str) -> DataFrame:
    return df.select(*NODE, F.explode(classes).alias("c")).distinct().groupBy(*NODE).agg(F.sort_array(F.collect_set("c")).alias(name))


def direct_permissions(registrations: DataFrame) -> DataFrame:
    """Union of permission categories of a node's tools; at most nine per node."""
    return _per_node(registrations, tool_permissions(F.col("tool")), "direct")


def transitive_permissions(direct: DataFrame, far: DataFrame) -> DataFrame:
    """Permissions a node can reach through the graph; `far` is graph.reach over all edges."""
    held = direct.select("repo_id", F.col("node_id").alias("node"), F.explode("direct").alias("c"))
    got = far.join(direct.select("repo_id", F.col("node_id").alias("origin")), ["repo_id", "origin"], "left_semi").join(held, ["repo_id", "node"]).select("repo_id", F.col("origin").alias("node_id"), "c").distinct()
    reach = got.groupBy(*NODE).agg(F.collect_set("c").alias("reach"))
    j = direct.join(reach, NODE, "left").withColumn("reach", F.coalesce("reach", F.array().cast("array<string>")))
    j = j.withColumn("effective", F.sort_array(F.array_union("direct", "reach"))).withColumn("escalated", F.sort_array(F.array_except("reach", "direct")))
    return j.select(*NODE, "direct", "effective", "escalated", F.size("effective").alias("blast_radius"), F.size("escalated").alias("escalation_count"))


def escalation_paths(direct: DataFrame, far: DataFrame) -> DataFrame:
    """For each escalated permission, the nearest reachable node that holds it."""
    held = direct.select("repo_id", F.col("node_id").alias("node"), F.explode("direct").alias("permission"))
    own = held.withColumnRenamed("node", "origin")
    p = far.join(held, ["repo_id", "node"]).join(direct.select("repo_id", F.col("node_id").alias("origin")), ["repo_id", "origin"], "left_semi").join(own, ["repo_id", "origin", "permission"], "left_anti")
    return p.groupBy("repo_id", F.col("origin").alias("node_id"), "permission").agg(F.min_by("node", F.struct("depth", "node")).alias("via"))


def asymmetries(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target holds permissions the source lacks, with a risk level."""
    none = F.array().cast("array<string>")
    j = edges.select("repo_id", "edge_id", "source", "target")
    for end in ("source", "target"):
        j = j.join(direct.select("repo_id", F.col("node_id").alias(end), F.col("direct").alias(f"_{end}")), ["repo_id", end], "left")
    j = j.withColumn("gained", F.sort_array(F.array_except(F.coalesce("_target", none), F.coalesce("_source", none)))).filter(F.size("gained") > 0)
    has = lambda *p: F.arrays_overlap("gained", F.array(*[F.lit(x) for x in p]))
    risk = F.when(has("system_admin", "execute_code"), "critical").when(has("write_data", "database"), "high").otherwise("medium")
    return j.select("repo_id", "edge_id", "source", "target", "gained", risk.alias("risk_level"))


def unused_permissions(direct: DataFrame, calls: DataFrame) -> DataFrame:
    """Registered permissions never used at run time, and the utilisation rate."""
    used = direct_permissions(calls).withColumnRenamed("direct", "used")
    j = direct.join(used, NODE, "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>")))
    return j.select(*NODE, F.sort_array(F.array_except("direct", "used")).alias("unused"), ratio(F.size(F.array_intersect("direct", "used")), F.size("direct")).alias("utilization_rate"))


def permission_risk(direct: DataFrame, far: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    t = transitive_permissions(direct, far).groupBy("repo_id").agg(F.max("blast_radius").alias("max_blast_radius"), F.sum("escalation_count").alias("total_escalation_count"))
    a = asymmetries(direct, edges).groupBy("repo_id").agg(count_if(F.col("risk_level") == "critical").alias("critical_asymmetries"))
    u = unused_permissions(direct, calls).groupBy("repo_id").agg(F.avg("utilization_rate").alias("mean_utilization_rate"))
    j = t.join(a, "repo_id", "left").join(u, "repo_id").fillna(0)
    score = F.least(F.lit(1.0), F.col("critical_asymmetries") * 0.3 + F.col("total_escalation_count") * 0.05)
    return j.withColumn("permission_risk_score", score).withColumn("finding_triggered", score > 0.3)


# ---- privacy ---------------------------------------------------------------------
def node_domains(nodes: DataFrame, registrations: DataFrame, state: DataFrame) -> DataFrame:
    """(repo_id, node_id, domains): data domains of a node's tools and state keys, else generic."""
    texts = registrations.select(*NODE, F.col("tool").alias("t")).unionByName(state.select("repo_id", F.col("accessor").alias("node_id"), F.col("state_key").alias("t"))).distinct()
    d = _per_node(texts, data_domains(F.col("t")), "domains")
    return nodes.select(*NODE).distinct().join(d, NODE, "left").withColumn("domains", F.coalesce("domains", F.array(F.lit("generic"))))


def state_accesses(events: DataFrame) -> DataFrame:
    a, k = nz(F.col("payload.accessor_node")), nz(F.col("payload.state_key"))
    return events.filter((F.col("event_type") == "state.access") & a.isNotNull() & k.isNotNull()).select("repo_id", a.alias("accessor"), k.alias("state_key")).distinct()


def fan_in(domains: DataFrame, edges: DataFrame) -> DataFrame:
    """Data domains that converge on each node over its incoming edges."""
    into = edges.select("repo_id", "source", F.col("target").alias("node_id")).join(domains.select("repo_id", F.col("node_id").alias("source"), "domains"), ["repo_id", "source"], "left")
    n = edges.groupBy("repo_id", F.col("target").alias("node_id")).agg(F.count(F.lit(1)).alias("incoming_edges"))
    d = into.select(*NODE, F.explode(F.coalesce("domains", F.array(F.lit("generic")))).alias("d")).distinct().groupBy(*NODE).agg(F.sort_array(F.collect_set("d")).alias("converging"))
    j = domains.select(*NODE).join(n, NODE, "left").join(d, NODE, "left").fillna(0).withColumn("converging", F.coalesce("converging", F.array().cast("array<string>")))
    k = F.size("converging")
    return j.select(*NODE, "incoming_edges", "converging", k.alias("domain_count"), F.when(k >= 3, "high").when(k == 2, "medium").otherwise("low").alias("fan_in_risk"))


def cross_domain_flows(domains: DataFrame, edges: DataFrame) -> DataFrame:
    j = edges.select("repo_id", "edge_id", "source", "target")
    generic = F.array(F.lit("generic"))
    for end in ("source", "target"):
        j = j.join(domains.select("repo_id", F.col("node_id").alias(end), F.col("domains").alias(f"_{end}")), ["repo_id", end], "left")
    j = j.withColumn("new_domains", F.sort_array(F.array_except(F.coalesce("_target", generic), F.coalesce("_source", generic))))
    return j.filter(F.size("new_domains") > 0).select("repo_id", "edge_id", "source", "target", "new_domains")


def privacy_exposure(domains: DataFrame, edges: DataFrame) -> DataFrame:
    f = fan_in(domains, edges).groupBy("repo_id").agg(count_if(F.col("fan_in_risk") == "high").alias("nodes_with_high_fan_in"), F.max("domain_count").alias("max_domain_convergence"))
    x = cross_domain_flows(domains, edges).groupBy("repo_id").agg(F.count(F.lit(1)).alias("cross_domain_edges"))
    j = f.join(x, "repo_id", "left").fillna(0)
    score = F.least(F.lit(1.0), F.col("nodes_with_high_fan_in") * 0.2 + F.col("cross_domain_edges") * 0.1)
    return j.withColumn("privacy_exposure_score", score).withColumn("finding_triggered", score > 0.3)
