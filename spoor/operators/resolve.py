"""Resolution of runtime node references to structural graph nodes.

Every strategy (exact id, runtime id, derived ids, equal names, containment) becomes an
equi-join on (repo_id, kind, key): references and nodes are both exploded into typed keys, and
the best hit by (priority, node order) wins. Containment joins on the first three characters
of the needle, so it needs no all-pairs comparison. One join resolves every distinct reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spoor.functions.text import data_store_id, external_id, normalize_name, nz

GRAM = 3


def grams(text: Column) -> Column:
    """All substrings of one to three characters. Repeats stay: dropping them in the row costs more
    than the joins, whose results are made distinct anyway."""
    def of(n: int) -> Column:
        return F.when(
            F.length(text) >= n,
            F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))),
        ).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(1, GRAM + 1)])


def _key(priority: int, kind: str, key: Column, check: Column | None = None, gate: Column | None = None) -> Column:
    s = F.struct(
        F.lit(priority).alias("priority"), F.lit(kind).alias("kind"), key.cast("string").alias("key"),
        (check if check is not None else F.lit(None)).cast("string").alias("check"),
    )
    keep = key.isNotNull() & (key != "")
    return F.when(keep if gate is None else keep & gate, s)


def node_keys(nodes: DataFrame) -> DataFrame:
    """nodes(repo_id, node_id, node_ord, name, class_name, source_file, line_number) -> typed lookup keys."""
    one = lambda kind, key, check=None: F.array(_key(0, kind, key, check))
    line = F.when(nz(F.col("source_file")).isNotNull(), F.col("line_number"))
    keys = F.concat(
        one("id", F.col("node_id")),
        one("norm", normalize_name(F.col("name"))),
        one("norm", normalize_name(F.col("class_name"))),
        one("line", line.cast("string"), F.col("source_file")),
        F.transform(grams(F.col("node_id")), lambda g: _key(0, "gram", g, F.col("node_id"))),
    )
    return (
        nodes.select("repo_id", "node_id", "node_ord", F.explode(F.array_compact(keys)).alias("k"))
        .select("repo_id", "node_id", "node_ord", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"), F.col("k.check").alias("held"))
    )


def _runtime_keys(parts: Column, cls: Column, start: int) -> list[Column]:
    """Strategies for ids of the form framework:Class:file:line."""
    gate = F.size(parts) >= 4
    base = F.concat(F.lit("agent_"), cls)
    suffixed = [
        _key(start + 1 + i, "id", F.concat(base, F.lit(sfx)), gate=gate & ~F.endswith(cls, F.lit(sfx)))
        for i, sfx in enumerate(["_agent", "_crew", "_graph"])
    ]
    return [
        _key(start, "id", base, gate=gate), *suffixed,
        _key(start + 4, "line", F.get(parts, F.lit(3)), F.get(parts, F.lit(2)), gate=gate),
        _key(start + 5, "gram", F.left(cls, F.lit(GRAM)), cls, gate=gate),
    ]


def resolve_refs(refs: DataFrame, nodes: DataFrame, *, names_and_types: bool = True) -> DataFrame:
    """Map distinct references (repo_id, ref_id, ref_name) to structural node ids.

    `names_and_types` also tries equal normalised names or classes and data-store / external
    ids; without it only agent ids and containment are tried on names.
    """
    rid, name = nz(F.col("ref_id")), nz(F.col("ref_name"))
    parts = F.split(rid, ":")
    # the normalised forms are bound once per row; the lambda below only reads them
    forms = F.struct(rid.alias("rid"), name.alias("name"), normalize_name(name).alias("norm"), parts.alias("parts"), normalize_name(F.get(parts, 1)).alias("cls"))

    def keys_of(f: Column) -> Column:
        keys = [_key(1, "id", f["rid"]), *_runtime_keys(f["parts"], f["cls"], 2), _key(10, "id", F.concat(F.lit("agent_"), f["norm"]))]
        if names_and_types:
            keys += [_key(11, "norm", f["norm"]), _key(12, "id", data_store_id(f["name"])), _key(13, "id", external_id(f["name"]))]
        keys += [_key(14, "gram", F.left(f["norm"], F.lit(GRAM)), f["norm"])]
        return F.array_compact(F.array(*keys))

    wanted = (
        refs.select("repo_id", "ref_id", "ref_name", F.explode(F.flatten(F.transform(F.array(forms), keys_of))).alias("k"))
        .select("repo_id", "ref_id", "ref_name", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"), F.col("k.priority").alias("priority"), F.col("k.check").alias("needle"))
    )
    hits = wanted.join(node_keys(nodes), ["repo_id", "kind", "key"]).filter(
        F.when(F.col("kind") == "gram", F.contains(F.col("held"), F.col("needle")))
        .when(F.col("kind") == "line", F.endswith(F.col("needle"), F.col("held")))
        .otherwise(F.lit(True))
    )
    best = hits.groupBy("repo_id", "ref_id", "ref_name").agg(F.min(F.struct("priority", "node_ord", "node_id")).alias("b"))
    return best.select("repo_id", "ref_id", "ref_name", F.col("b.node_id").alias("node_id"))


def event_refs(events: DataFrame) -> DataFrame:
    """Distinct references of the events: both ends and the agent named in the payload."""
    agent = F.coalesce(nz(F.col("payload.agent_id")), nz(F.col("payload.agent_name")))
    ref = lambda s: F.struct(F.coalesce(F.col(f"{s}.node_id"), F.lit("")).alias("ref_id"), F.coalesce(F.col(f"{s}.node_name"), F.lit("")).alias("ref_name"))
    all_refs = F.array(
        F.when(F.col("source_node").isNotNull(), ref("source_node")),
        F.when(F.col("target_node").isNotNull(), ref("target_node")),
        F.when(agent.isNotNull(), F.struct(F.lit("").alias("ref_id"), agent.alias("ref_name"))),
    )
    return events.select("repo_id", F.explode(F.array_compact(all_refs)).alias("r")).select("repo_id", "r.ref_id", "r.ref_name").distinct()


def node_ref_map(events: DataFrame, nodes: DataFrame, *, names_and_types: bool = True) -> DataFrame:
    return resolve_refs(event_refs(events), nodes, names_and_types=names_and_types)


def with_resolved(events: DataFrame, ref_map: DataFrame, side: str, name: str) -> DataFrame:
    """Add the resolved id of one end (null when nothing matches)."""
    m = ref_map.select("repo_id", F.col("ref_id").alias("_rid"), F.col("ref_name").alias("_rname"), F.col("node_id").alias(name))
    e = events.withColumn("_rid", F.coalesce(F.col(f"{side}.node_id"), F.when(F.col(side).isNotNull(), F.lit(""))))
    e = e.withColumn("_rname", F.coalesce(F.col(f"{side}.node_name"), F.when(F.col(side).isNotNull(), F.lit(""))))
    return e.join(m, ["repo_id", "_rid", "_rname"], "left").drop("_rid", "_rname")


def resolved_ids(events: DataFrame, ref_map: DataFrame) -> DataFrame:
    """Events with source and target node ids rewritten to structural ids where they resolve."""
    e = with_resolved(with_resolved(events, ref_map, "source_node", "_s"), ref_map, "target_node", "_t")
    fix = lambda side, got: F.when(F.col(side).isNotNull(), F.struct(
        F.col(f"{side}.node_type").alias("node_type"), F.coalesce(F.col(got), F.col(f"{side}.node_id")).alias("node_id"), F.col(f"{side}.node_name").alias("node_name")))
    return e.withColumn("source_node", fix("source_node", "_s")).withColumn("target_node", fix("target_node", "_t")).drop("_s", "_t")


def name_to_id(nodes: DataFrame) -> DataFrame:
    """lookup(repo_id, ref, node_id): ids map to themselves; a name wins over an equal id, later nodes over earlier."""
    both = nodes.select("repo_id", "node_ord", "node_id", F.explode(F.array("node_id", F.col("name"))).alias("ref"))
    return both.filter(nz(F.col("ref")).isNotNull()).groupBy("repo_id", "ref").agg(F.max_by("node_id", "node_ord").alias("node_id"))


def lookup_keys(ref: Column) -> Column:
    """Lookup order of a reference: itself, then the class part of a runtime id."""
    return F.array_compact(F.array(nz(ref), F.get(F.split(ref, ":"), 1)))


def containing(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """Pairs with left.a equal to, inside, or around right.b, per key, without all-pairs work.

    Each direction is an equi-join on the first three characters of the inner text.
    """
    def one(inner: DataFrame, x: str, outer: DataFrame, y: str) -> DataFrame:
        i = inner.withColumn("_g", F.left(F.col(x), F.lit(GRAM)))
        o = outer.withColumn("_g", F.explode(F.concat(grams(F.col(y)), F.array(F.lit("")))))
        return i.join(o, [*on, "_g"]).filter(F.contains(F.col(y), F.col(x))).drop("_g")

    cols = [*on, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on]]
    return one(left, a, right, b).select(*cols).unionByName(one(right, b, left, a).select(*cols)).distinct()
