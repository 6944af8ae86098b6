"""Graph and search operators on inputs beyond the sizes of the test tables."""

import random
import time

from pyspark.sql import functions as F

from spoor.operators import fingerprint, graph, motifs, quality
from spoor.sources import jsonl

EDGE = "repo_id string, edge_id string, source string, target string, edge_type string"


def edges(spark, pairs):
    return spark.createDataFrame([("r", f"e{i}", a, b, "delegates_to") for i, (a, b) in enumerate(pairs)], EDGE)


def test_long_chain(spark):
    chain = edges(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(15)])
    assert graph.longest_path(chain).first()["nodes"] == 16


def test_ring(spark):
    ring = edges(spark, [(f"n{i}", f"n{(i + 1) % 10}") for i in range(10)])
    assert [r["cycle"] for r in graph.simple_cycles(ring).collect()] == [[f"n{i}" for i in range(10)]]


def test_chain_of_seventy(spark):
    rows = motifs.linear_chains(edges(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(69)]))
    assert rows.count() == 70


def test_many_query_vectors(spark):
    q = spark.range(2500).select(F.col("id").cast("string").alias("query_id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("qvec"))
    base = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vec array<double>")
    got = fingerprint.nearest(q, base, k=1).filter("query_id <> '0'").groupBy("id").count().collect()
    assert [(r["id"], r["count"]) for r in got] == [("a", 2499)]


def test_own_instrumentation_names(spark):
    run = spark.createDataFrame([("DONE", 1, "error in my_tracer", 0, False)], "status string, exit_code int, stderr string, events int, has_interaction boolean")
    assert run.select(quality.status(run)).first()[0] == "CRASH"
    assert run.select(quality.status(run, ["my_tracer"])).first()[0] == "INSTRUMENTATION_FAILURE"


def test_written_table_reads_back(spark, tmp_path):
    jsonl.write_table(spark.range(3), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3


def plain_longest(pairs, roots, closing):
    ways = {}
    for a, b in pairs:
        ways.setdefault(a, set()).add(b)
    best = 0

    def walk(node, seen):
        nonlocal best
        best = max(best, len(seen) + (1 if closing and ways.get(node) else 0))
        for n in ways.get(node, ()):
            if n not in seen:
                walk(n, seen | {n})

    for r in roots if roots is not None else list(ways):
        walk(r, {r})
    return best


def test_longest_path_of_random_graphs(spark):
    rng = random.Random(21)
    graphs = {f"g{i}": sorted({(f"n{rng.randrange(k)}", f"n{rng.randrange(k)}") for _ in range(rng.randrange(1, 14))}) for i, k in enumerate([3, 5, 6, 7, 8] * 8)}
    rows = [(g, f"e{i}", a, b, "delegates_to") for g, pairs in graphs.items() for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, EDGE)
    for closing in (False, True):
        got = {r["repo_id"]: r["nodes"] for r in graph.longest_path(df, closing=closing).collect()}
        assert got == {g: plain_longest(p, None, closing) for g, p in graphs.items()}
    roots = {g: rng.sample([f"n{i}" for i in range(8)], 2) for g in graphs}
    got = graph.longest_path(df, spark.createDataFrame([(g, n) for g, ns in roots.items() for n in ns], "repo_id string, node string"))
    assert {r["repo_id"]: r["nodes"] for r in got.collect()} == {g: plain_longest(p, roots[g], False) for g, p in graphs.items()}


def test_layered_graph_of_two_hundred_nodes(spark):
    """Paths through ten full layers cannot be listed (20 ** 10), but every node is a component of its own."""
    layers = [[f"l{i}_{j:02d}" for j in range(20)] for i in range(10)]
    pairs = [(a, b) for up, down in zip(layers, layers[1:]) for a in up for b in down] + [("l9_00", "l9_01"), ("l9_01", "l9_00")]
    start = time.time()
    assert graph.longest_path(edges(spark, pairs)).first()["nodes"] == 11
    assert time.time() - start < 120
