"""Points in intervals and actual error paths against plain loops."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spoor.functions import intervals
from spoor.operators import actual_paths as A


def test_stab_equals_all_pairs(spark):
    rng = random.Random(9)
    spans = [(rng.choice("ab"), i, lo, lo + rng.choice([0, 1, 2, 3, 17, 200, -4])) for i, lo in ((i, rng.randrange(150)) for i in range(300))] + [("a", 900, 0, 400), ("c", 901, 0, 5), (None, 902, 0, 5)]
    points = [(rng.choice("abx"), j, rng.randrange(420)) for j in range(200)] + [(None, 300, 2)]
    got = intervals.stab(spark.createDataFrame(spans, "k string, i int, lo long, hi long"), spark.createDataFrame(points, "k string, j int, p long"), ["k"], "lo", "hi", "p")
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for k, i, lo, hi in spans for x, j, p in points if k is not None and k == x and lo <= p < hi)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**40), st.integers(0, 2**20))
def test_blocks_cover_an_interval_once(spark_blocks, low, size):
    blocks = spark_blocks(low, low + size)
    ranges = sorted((n << k, (n + 1) << k) for k, n in blocks)
    assert sum(b - a for a, b in ranges) == size and len(blocks) <= 2 * 42
    assert all(a2 == b1 for (_, b1), (a2, _) in zip(ranges, ranges[1:])) and (not ranges or ranges[0][0] == low)


import pytest  # noqa: E402


@pytest.fixture(scope="module")
def spark_blocks(spark):
    def blocks(low, high):
        row = spark.range(1).select(intervals.blocks_of(F.lit(low).cast("long"), F.lit(high).cast("long")).alias("b")).first()
        return [(b["level"], b["number"]) for b in row["b"]]

    return blocks


def plain_traces(rows):
    out = {}
    for run in {r[1] for r in rows}:
        ev = sorted((r for r in rows if r[1] == run), key=lambda r: (r[3], r[2]))
        bad = lambda r: r[4] in ("error.occurred", "error.propagated") or (r[4] in ("agent.task_end", "tool.completed") and r[6][0] in ("failed", "error"))
        met = set()
        for i, r in enumerate(ev):
            if not (r[4].startswith("error.") or (r[4] in ("agent.task_end", "tool.completed") and r[6][0] == "error")):
                continue
            node = r[5][0] or None
            if node and node in met:
                continue
            met.add(node)
            path = [node] if node else []
            for e in ev[i + 1 :]:
                n = e[5][0]
                if bad(e) and n and n not in path:
                    path.append(n)
            how = "end_of_chain" if path else "no_propagation"
            for e in ev[i + 1 :]:
                if path and e[5][0] == path[-1]:
                    if e[4] == "agent.task_end" and e[6][0] == "success":
                        how = "retry_succeeded"
                        break
                    if "guard" in path[-1].lower() or "review" in path[-1].lower():
                        how = "error_boundary"
                        break
            out[run, r[2]] = (node, path, how)
    return out


def test_actual_traces(spark):
    rng = random.Random(12)
    kinds = ["error.occurred", "error.propagated", "agent.task_end", "tool.completed", "agent.task_start"]
    rows = [("p", f"r{rng.randrange(5)}", f"e{i:03d}", rng.randrange(150), rng.choice(kinds), (rng.choice(["a", "b", "c", "guard_x", "Reviewer", "d", ""]), ""), (rng.choice(["success", "error", "failed", None]), None, "h")) for i in range(300)]
    df = spark.createDataFrame(rows, "repo_id string, run_id string, event_id string, timestamp_ns long, event_type string, source_node struct<node_id:string,node_name:string>, payload struct<status:string,node_id:string,error_handling:string>")
    got = {(r["run_id"], r["event_id"]): (r["source"], r["actual_path"], r["stop_mechanism"]) for r in A.actual_traces(df).collect()}
    assert got == plain_traces(rows)
    assert A.actual_traces(df.limit(0)).count() == 0


def test_normalized_traces(spark):
    rows = [("new", '{"error_source_node":"a","structural_predicted_path":["a","b"],"actual_observed_path":["a"],"stop_mechanism":"retry","downstream_impact":{"nodes_affected":3},"structural_prediction_match":true,"run_id":"r"}'),
            ("old", '{"origin_node":"o","origin_error_type":"T","propagation_path":["x"],"error_handling_observed":"h","downstream_impact":true}'), ("none", '{"error_source_node":null,"downstream_impact":false,"actual_observed_path":"x"}'), ("odd", '{"downstream_impact":5}')]
    df = spark.createDataFrame(rows, "k string, raw string").select("k", F.try_parse_json("raw").alias("t"))
    got = {r["k"]: r.asDict() for r in A.normalized_traces(df).collect()}
    pick = lambda k, *c: tuple(got[k][x] for x in c)
    assert pick("new", "error_source_node", "structural_predicted_path", "actual_observed_path", "stop_mechanism", "structural_prediction_match", "run_id") == ("a", ["a", "b"], ["a"], "retry", True, "r")
    assert pick("new", *A.IMPACT) == (3, 0, 0, 0) and pick("old", *A.IMPACT) == (1, 1, 0, 1) and pick("none", *A.IMPACT) == pick("odd", *A.IMPACT) == (0, 0, 0, 0)
    assert pick("old", "error_source_node", "error_type", "structural_predicted_path", "actual_observed_path", "stop_mechanism") == ("o", "T", ["x"], ["x"], "h")
    assert pick("none", "error_source_node", "actual_observed_path") == ("", [])
