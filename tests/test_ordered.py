"""The range-cut scans equal a plain pass over each key, however small the ranges are."""

import random

import pytest
from pyspark.sql import functions as F

from spoor.functions.ordered import element_at_rank, order_ranges, percentiles, scan


def rows(n=400, seed=3):
    r = random.Random(seed)
    # one key holds most rows
    return [("hot" if r.random() < 0.7 else f"k{r.randint(0, 5)}", r.randint(0, 60), f"e{i:04d}", r.randint(-5, 9), None if r.random() < 0.5 else f"v{i}") for i in range(n)]


@pytest.mark.parametrize("limit", [7, 50, 10_000])
@pytest.mark.parametrize("direction", ["before", "after"])
@pytest.mark.parametrize("inclusive", [False, True])
def test_scan_by_row(spark, limit, direction, inclusive):
    data = rows()
    df = spark.createDataFrame(data, "k string, t long, id string, x long, v string")
    got = scan(df, ["k"], "t", {"s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x")), "near": ("nearest", F.col("v"))}, tie=["id"], direction=direction, inclusive=inclusive, rows_per_bucket=limit)
    got = {r["id"]: (r["s"], r["lo"], r["hi"], r["near"]) for r in got.collect()}
    for k, t, i, x, v in data:
        side = [o for o in data if o[0] == k and ((o[1], o[2]) < (t, i) if direction == "before" else (o[1], o[2]) > (t, i) if direction == "after" else False)]
        if inclusive:
            side.append((k, t, i, x, v))
        side.sort(key=lambda o: (o[1], o[2]), reverse=direction == "before")
        near = next((o[4] for o in side if o[4] is not None), None)
        xs = [o[3] for o in side]
        assert got[i] == (sum(xs), min(xs, default=None), max(xs, default=None), near)


@pytest.mark.parametrize("limit", [11, 10_000])
def test_scan_by_value(spark, limit):
    data = rows()
    df = spark.createDataFrame(data, "k string, t long, id string, x long, v string")
    got = {r["id"]: r["s"] for r in scan(df, ["k"], "t", {"s": ("sum", F.col("x"))}, direction="after", rows_per_bucket=limit).collect()}
    for k, t, i, *_ in data:
        assert got[i] == sum(o[3] for o in data if o[0] == k and o[1] > t)


@pytest.mark.parametrize("limit", [5, 10_000])
def test_percentiles(spark, limit):
    import numpy as np

    r = random.Random(1)
    data = [("hot" if r.random() < 0.8 else "cold", round(r.random() * 100, 2)) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, x double")
    for row in percentiles(df, ["k"], "x", {"p50": 0.5, "p95": 0.95}, rows_per_bucket=limit).collect():
        xs = [x for k, x in data if k == row["k"]]
        assert row["p50"] == pytest.approx(np.percentile(xs, 50)) and row["p95"] == pytest.approx(np.percentile(xs, 95))
    mid = {x["k"]: x["m"] for x in element_at_rank(df, ["k"], "x", F.floor(F.col("_total") / 2), "m", rows_per_bucket=limit).collect()}
    for k, m in mid.items():
        xs = sorted(x for g, x in data if g == k)
        assert m == xs[len(xs) // 2]


def test_ranges_stay_near_the_limit_in_a_burst(spark):
    r = random.Random(2)
    # nearly all rows fall into ten time values, half of them into one
    data = [("hot", 10**9 if i < 10 else 500 if i % 2 else 490 + r.randint(0, 9), f"e{i:05d}") for i in range(5000)]
    df = spark.createDataFrame(data, "k string, t long, id string")
    sizes = [x["count"] for x in order_ranges(df, ["k"], "t", ["id"], 5000, 100).groupBy("k", "_b").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 200
    got = {x["id"]: x["n"] for x in scan(df, ["k"], "t", {"n": ("sum", F.lit(1))}, tie=["id"], rows_per_bucket=100).collect()}
    assert got == {i: n for n, (_, _, i) in enumerate(sorted(data, key=lambda d: (d[1], d[2])))}
