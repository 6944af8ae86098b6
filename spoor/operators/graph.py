"""Iterative graph operators over all repositories at once.

Graphs are edge tables keyed by repo_id. Every loop advances one level for all graphs in one
join on (repo_id, node), so work spreads by node, not by repository; each level is
checkpointed and the loop stops when the frontier is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spoor.session import cut


def arcs(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Distinct (repo_id, source, target), optionally of some edge types."""
    e = edges if types is None else edges.filter(F.col("edge_type").isin(types))
    return e.filter((F.col("source") != "") & (F.col("target") != "")).select("repo_id", "source", "target").distinct()


def reach(edges: DataFrame, *, types: list[str] | None = None, origins: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(repo_id, origin, node, depth): nodes reachable from each origin with the least depth (>= 1).

    The origin itself is left out. `origins` (repo_id, node) limits where walks start.
    """
    step = cut(arcs(edges, types))
    start = step if origins is None else step.join(origins.select("repo_id", F.col("node").alias("source")), ["repo_id", "source"], "left_semi")
    frontier = start.filter("source <> target").select("repo_id", F.col("source").alias("origin"), F.col("target").alias("node"), F.lit(1).alias("depth"))
    frontier = cut(frontier)
    seen, depth = frontier, 1
    while max_depth is None or depth < max_depth:
        depth += 1
        moved = (
            frontier.select("repo_id", "origin", F.col("node").alias("source"))
            .join(step, ["repo_id", "source"])
            .filter("target <> origin")
            .select("repo_id", "origin", F.col("target").alias("node")).distinct()
        )
        frontier = cut(moved.join(seen.select("repo_id", "origin", "node"), ["repo_id", "origin", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def closest_levels(edges: DataFrame, roots: DataFrame, *, types: list[str] | None = None) -> DataFrame:
    """(repo_id, root, node, depth) by breadth-first search from each root, the root at depth 0."""
    far = reach(edges, types=types, origins=roots).select("repo_id", F.col("origin").alias("root"), "node", "depth")
    return far.unionByName(roots.select("repo_id", F.col("node").alias("root"), "node", F.lit(0).alias("depth")))


def breadth_first(edges: DataFrame) -> DataFrame:
    """(repo_id, origin, node, depth, via): reach with discovery order.

    `via` is the smallest sequence of edge positions among shortest paths; sorting by
    (depth, via) is the order in which a breadth-first search meets the nodes.
    """
    step = cut(edges.filter((F.col("source") != "") & (F.col("target") != "")).groupBy("repo_id", "source", "target").agg(F.min("edge_ord").alias("ord")))
    frontier = cut(step.filter("source <> target").select("repo_id", F.col("source").alias("origin"), F.col("target").alias("node"), F.lit(1).alias("depth"), F.array("ord").alias("via")))
    seen, depth = frontier, 1
    while not frontier.isEmpty():
        depth += 1
        moved = (
            frontier.select("repo_id", "origin", F.col("node").alias("source"), "via").join(step, ["repo_id", "source"]).filter("target <> origin")
            .groupBy("repo_id", "origin", F.col("target").alias("node")).agg(F.min(F.array_append("via", F.col("ord"))).alias("via"))
        )
        frontier = cut(moved.join(seen.select("repo_id", "origin", "node"), ["repo_id", "origin", "node"], "left_anti").select("repo_id", "origin", "node", F.lit(depth).alias("depth"), "via"))
        seen = seen.unionByName(frontier)
    return seen


def components(arcs_: DataFrame) -> DataFrame:
    """(repo_id, node, component) for nodes on a cycle; a component is named by its smallest node.

    Nodes without a way in or out are peeled off first, so forward and backward labels are spread among the rest alone.
    """
    core = cut(arcs_.filter("source <> target").select("repo_id", "source", "target").distinct())
    n = core.count()
    while n:
        out, into = core.select("repo_id", F.col("source").alias("target")).distinct(), core.select("repo_id", F.col("target").alias("source")).distinct()
        core = cut(core.join(out, ["repo_id", "target"], "left_semi").join(into, ["repo_id", "source"], "left_semi"))
        before, n = n, core.count()
        if n == before:
            break
    forward = reach(core).select("repo_id", "origin", "node")
    backward = forward.select("repo_id", F.col("node").alias("origin"), F.col("origin").alias("node"))
    mutual = forward.join(backward, ["repo_id", "origin", "node"], "left_semi")
    return mutual.groupBy("repo_id", F.col("origin").alias("node")).agg(F.least(F.min("node"), F.col("origin")).alias("component"))


def longest_path(edges: DataFrame, roots: DataFrame | None = None, *, types: list[str] | None = None, closing: bool = False) -> DataFrame:
    """(repo_id, nodes): node count of the longest simple path from the roots (all sources if none given).

    With `closing`, a last step back into a visited node counts as one more node.

    A simple path runs through strongly connected components in order, so the components are walked level by level:
    a node's entry value is the longest path that can end before it. Only inside a component of several nodes are
    sets of visited nodes kept (last node, set), merged over orders and entries; the problem is exponential in the
    size of its largest component, not in the size of the graph. The result is exact.
    """
    step = cut(arcs(edges, types))
    begin = (step.select("repo_id", F.col("source").alias("node")) if roots is None else roots.select("repo_id", "node")).distinct()
    nodes = step.select("repo_id", F.explode(F.array("source", "target")).alias("node")).unionByName(begin).distinct()
    label = cut(nodes.join(components(step), ["repo_id", "node"], "left").select("repo_id", "node", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("many")))
    at = lambda end: label.select("repo_id", F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    ways = cut(step.join(at("source"), ["repo_id", "source"]).join(at("target"), ["repo_id", "target"]).select("repo_id", "source", "target", "source_in", "target_in"))
    across, inside = ways.filter("source_in <> target_in"), ways.filter("source_in = target_in AND source <> target").select("repo_id", "source", "target")
    entry = cut(begin.withColumn("value", F.lit(0)))
    left, lengths = cut(label.select("repo_id", "component").distinct()), None
    while not left.isEmpty():
        held = across.join(left.withColumnRenamed("component", "source_in"), ["repo_id", "source_in"], "left_semi").select("repo_id", F.col("target_in").alias("component")).distinct()
        left, now = cut(left.join(held, ["repo_id", "component"], "left_semi")), left.join(held, ["repo_id", "component"], "left_anti")
        open_ = cut(entry.join(label, ["repo_id", "node"]).join(now, ["repo_id", "component"], "left_semi").groupBy("repo_id", "node", "many").agg(F.max("value").alias("value")))
        ends = open_.select("repo_id", "node", (F.col("value") + 1).alias("nodes"))
        frontier = open_.filter("many").select("repo_id", "node", F.array("node").alias("visited"), "value")
        while not frontier.isEmpty():
            f = frontier.withColumnRenamed("node", "source").join(inside, ["repo_id", "source"]).filter(~F.array_contains("visited", F.col("target")))
            grown = f.select("repo_id", F.col("target").alias("node"), F.array_sort(F.array_append("visited", F.col("target"))).alias("visited"), "value")
            frontier = cut(grown.groupBy("repo_id", "node", "visited").agg(F.max("value").alias("value")))
            ends = ends.unionByName(frontier.select("repo_id", "node", (F.col("value") + F.size("visited")).alias("nodes")))
        done = cut(ends.groupBy("repo_id", "node").agg(F.max("nodes").alias("nodes")))
        lengths = done if lengths is None else lengths.unionByName(done)
        pushed = done.withColumnRenamed("node", "source").join(across, ["repo_id", "source"]).select("repo_id", F.col("target").alias("node"), F.col("nodes").alias("value"))
        entry = cut(entry.join(open_.select("repo_id", "node"), ["repo_id", "node"], "left_anti").unionByName(pushed))
    if lengths is None:
        return begin.select("repo_id", F.lit(1).alias("nodes"))
    if closing:
        on = step.select("repo_id", F.col("source").alias("node")).distinct().withColumn("on", F.lit(1))
        lengths = lengths.join(on, ["repo_id", "node"], "left").withColumn("nodes", F.col("nodes") + F.coalesce("on", F.lit(0)))
    return lengths.groupBy("repo_id").agg(F.max("nodes").cast("int").alias("nodes"))


def simple_cycles(edges: DataFrame, *, types: list[str] | None = None) -> DataFrame:
    """(repo_id, cycle): simple cycles as node arrays that start at their smallest node.

    Walks only visit nodes greater than the root, so every cycle appears once; nodes outside
    any cycle are dropped first (a node in a cycle reaches itself).
    """
    step = arcs(edges, types)
    far = reach(edges, types=types)
    back = far.select("repo_id", F.col("origin").alias("target"), F.col("node").alias("source"))
    step = cut(step.filter("source <> target").join(back, ["repo_id", "source", "target"], "left_semi"))
    frontier = cut(step.filter("source < target").select("repo_id", F.array("source", "target").alias("path")))
    found = None
    while True:
        f = frontier.withColumn("source", F.element_at("path", -1))
        moved = f.join(step, ["repo_id", "source"]).withColumn("root", F.get("path", F.lit(0)))
        closed = moved.filter("target = root").select("repo_id", F.col("path").alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
        grown = moved.filter(F.col("target") > F.col("root")).filter(~F.array_contains("path", F.col("target")))
        frontier = cut(grown.select("repo_id", F.array_append("path", F.col("target")).alias("path")))
        if frontier.isEmpty():
            break
    return found


def shortest_cycles(edges: DataFrame, *, types: list[str] | None = None) -> DataFrame:
    """(repo_id, cycle): for every edge that lies on a cycle, the shortest cycle through it.

    Among equally short ones the smallest node sequence after the edge's target is taken. Cycles start
    at their smallest node and are distinct, so there are at most as many as edges: a cycle basis in
    polynomial work, where `simple_cycles` may list exponentially many. An edge from a node to itself is
    the cycle of that node. All graphs and origins advance together, one level per join.
    """
    step = cut(arcs(edges, types))
    own = step.filter("source = target").select("repo_id", F.array("source").alias("cycle"))
    far = reach(step).select("repo_id", F.col("origin").alias("target"), F.col("node").alias("source"))
    ring = cut(step.filter("source <> target").join(far, ["repo_id", "source", "target"], "left_semi"))
    frontier = ring.select("repo_id", F.col("target").alias("origin"), F.col("target").alias("node"), F.array("target").alias("path")).distinct()
    frontier = cut(frontier)
    seen = frontier
    while not frontier.isEmpty():
        moved = (
            frontier.select("repo_id", "origin", F.col("node").alias("source"), "path").join(ring, ["repo_id", "source"])
            .groupBy("repo_id", "origin", F.col("target").alias("node")).agg(F.min(F.array_append("path", F.col("target"))).alias("path"))
        )
        frontier = cut(moved.join(seen.select("repo_id", "origin", "node"), ["repo_id", "origin", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    back = ring.join(seen.select("repo_id", F.col("origin").alias("target"), F.col("node").alias("source"), "path"), ["repo_id", "source", "target"])
    low = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", low, F.size("path")), F.slice("path", F.lit(1), low - 1))
    return back.select("repo_id", turned.alias("cycle")).unionByName(own).distinct()


def chain_walk(next_of: DataFrame, roots: DataFrame, *, keys: list[str]) -> DataFrame:
    """Follow the first unvisited successor of each node from the roots.

    next_of(keys, source, target, ord) lists successors in order; result (keys, root, path).
    One row per root stays alive per level; each level is one join on (keys, node).
    """
    step = cut(next_of.groupBy(*keys, "source", "target").agg(F.min("ord").alias("ord")))
    alive = cut(roots.select(*keys, F.col("node").alias("root"), F.array("node").alias("path")))
    done = None
    while True:
        at = alive.withColumn("source", F.element_at("path", -1))
        onward = (
            at.join(step, [*keys, "source"]).filter(~F.array_contains("path", F.col("target")))
            .groupBy(*keys, "root").agg(F.min_by("target", F.struct("ord", "target")).alias("target"), F.first("path").alias("path"))
            .select(*keys, "root", F.array_append("path", F.col("target")).alias("path"))
        )
        onward = cut(onward)
        ended = alive.join(onward.select(*keys, "root"), [*keys, "root"], "left_anti")
        done = ended if done is None else done.unionByName(ended)
        alive = onward
        if alive.isEmpty():
            break
    return done


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node_id, out_degree, in_degree) for every node, isolated ones included."""
    ends = edges.select("repo_id", F.explode(F.array(
        F.struct(F.col("source").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("x")).select("repo_id", "x.*")
    ends = ends.unionByName(nodes.select("repo_id", "node_id", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return ends.groupBy("repo_id", "node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node_id, betweenness): shortest-path betweenness over all sources, / (n-1)(n-2).

    Forward levels carry path counts per (repo, origin, node); backward levels accumulate
    dependencies. All origins of all graphs advance together.
    """
    step = cut(arcs(edges).filter("source <> target"))
    frontier = cut(step.select("repo_id", F.col("source").alias("origin")).distinct().select("repo_id", "origin", F.col("origin").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("sigma")))
    levels = [frontier]
    seen = frontier
    while True:
        d = len(levels)
        moved = (
            frontier.select("repo_id", "origin", F.col("node").alias("source"), "sigma").join(step, ["repo_id", "source"])
            .groupBy("repo_id", "origin", F.col("target").alias("node")).agg(F.sum("sigma").alias("sigma"))
        )
        nxt = cut(moved.join(seen, ["repo_id", "origin", "node"], "left_anti").select("repo_id", "origin", "node", F.lit(d).alias("depth"), "sigma"))
        if nxt.isEmpty():
            break
        levels.append(nxt)
        seen = seen.unionByName(nxt)
        frontier = nxt
    delta = levels[-1].select("repo_id", "origin", "node", F.lit(0.0).alias("delta"))
    total = None
    for d in range(len(levels) - 1, 0, -1):
        child = levels[d].join(delta, ["repo_id", "origin", "node"]).select("repo_id", "origin", F.col("node").alias("target"), F.col("sigma").alias("sw"), F.col("delta").alias("dw"))
        part = child.select("repo_id", "origin", F.col("target").alias("node"), F.col("dw").alias("delta"))
        total = part if total is None else total.unionByName(part)
        up = (
            child.join(step, ["repo_id", "target"])
            .select("repo_id", "origin", F.col("source").alias("node"), "sw", "dw")
            .join(levels[d - 1].select("repo_id", "origin", "node", "sigma"), ["repo_id", "origin", "node"])
            .groupBy("repo_id", "origin", "node").agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("dw"))).alias("delta"))
        )
        delta = cut(levels[d - 1].select("repo_id", "origin", "node").join(up, ["repo_id", "origin", "node"], "left").fillna(0.0, ["delta"]))
    sizes = nodes.groupBy("repo_id").agg(F.count_distinct("node_id").alias("n"))
    base = nodes.select("repo_id", "node_id").distinct().join(sizes, "repo_id")
    if total is not None:
        sums = total.filter("origin <> node").groupBy("repo_id", F.col("node").alias("node_id")).agg(F.sum("delta").alias("raw"))
        base = base.join(sums, ["repo_id", "node_id"], "left")
    else:
        base = base.withColumn("raw", F.lit(0.0))
    norm: Column = (F.col("n") - 1) * (F.col("n") - 2)
    return base.select("repo_id", "node_id", F.when(norm > 0, F.coalesce("raw", F.lit(0.0)) / norm).otherwise(0.0).alias("betweenness"))


def cyclic_repos(edges: DataFrame, types: list[str]) -> DataFrame:
    """Repositories whose edges of `types` hold a cycle (repo_id): nodes without a way in or out are peeled off."""
    left = cut(edges.filter(F.col("edge_type").isin(types) & (F.col("source") != "") & (F.col("target") != "")).select("repo_id", "source", "target").distinct())
    n = left.count()
    while n:
        ways_out = left.select("repo_id", F.col("source").alias("target")).distinct()
        ways_in = left.select("repo_id", F.col("target").alias("source")).distinct()
        left = cut(left.join(ways_out, ["repo_id", "target"], "left_semi").join(ways_in, ["repo_id", "source"], "left_semi"))
        before, n = n, left.count()
        if n == before:
            break
    return left.select("repo_id").distinct()
