"""Streams run to their end: out-of-order steps, late rows, windows, sessions and replays."""

import random

from pyspark.sql import functions as F

from spoor.streaming import arrivals, depth

T0 = 1_704_067_200_000_000_000
MIN = 60_000_000_000
COLS = "repo_id string, run_id string, event_id string, timestamp_ns long, event_type string, payload struct<parent_node_id:string>"


def plain_depth(rows):
    d = top = 0
    for _, _, e, ns, kind, p in sorted(rows, key=lambda r: (r[3], r[2])):
        up = kind == "delegation.initiated" or (kind == "agent.task_start" and p[0])
        d = max(0, d + (1 if up else -1 if kind == "agent.task_end" else 0))
        top = max(top, d)
    return d, top


def test_depth_out_of_order(spark, tmp_path):
    rng = random.Random(4)
    kinds = ["delegation.initiated", "agent.task_end", "agent.task_start", "llm.call_end"]
    rows = []
    for i in range(600):
        run = f"u{i % 7}"
        rows.append(("r", run, f"e{i:04d}", T0 + i * MIN // 2 + rng.randrange(MIN), rng.choice(kinds), (rng.choice([None, "p"]),)))
    arrive = {r[2]: r[3] + (rng.randrange(4 * MIN) if rng.random() < 0.97 or r[1] in ("u0", "u1") else 90 * MIN) for r in rows}
    groups = [sorted(rows, key=lambda r: arrive[r[2]])[a : a + 100] for a in range(0, 600, 100)]
    like = spark.createDataFrame(rows, COLS)
    path = str(tmp_path / "in")
    for g in groups:
        spark.createDataFrame(g, COLS).coalesce(1).write.mode("append").parquet(path)
    arrivals.heartbeat(spark, like, path, T0 + 10_000 * MIN)
    stream = arrivals.arriving(spark, like, path, 1, "5 minutes")
    depths, late = depth.run_depth(stream, str(tmp_path / "out"), str(tmp_path / "ck"), partitions=2)

    top, want_late = 0, set()
    for g in groups:
        passed = top // 1_000_000 - 5 * 60_000 if top else -1
        want_late |= {r[2] for r in g if r[4] != "llm.call_end" and not (r[4] == "agent.task_start" and not r[5][0]) and r[3] // 1_000_000 <= passed}
        top = max(top, max(r[3] for r in g))
    got_late = {r["event_id"] for r in late.collect()}
    assert got_late == want_late and want_late
    by_run = {}
    for r in rows:
        by_run.setdefault(r[1], []).append(r)
    streamed = {r["run_id"]: (r["depth"], r["max_depth"]) for r in depths.collect()}
    for run, mine in by_run.items():  # the stream is right about the rows that were not late
        assert streamed[run] == plain_depth([r for r in mine if r[2] not in want_late])
    final = {r["run_id"]: r for r in depth.reconciled(depths, like).collect()}
    hurt = {r[1] for r in rows if r[2] in want_late}
    assert {u for u, r in final.items() if not r["from_stream"]} == hurt and hurt < set(by_run)
    assert {u: (r["depth"], r["max_depth"]) for u, r in final.items()} == {u: plain_depth(m) for u, m in by_run.items()}


def test_replayed_batch_replaces_itself(spark, tmp_path):
    write = arrivals.to_versions(str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    write(rows(("a", 1), ("b", 1)), 0)
    write(rows(("a", 5), ("a", 6)), 1)
    write(rows(("a", 2)), 1)
    versions = spark.read.schema("k string, v int, _batch long").option("basePath", str(tmp_path)).parquet(str(tmp_path))
    assert sorted(map(tuple, arrivals.latest(versions, ["k"]).collect())) == [("a", 2), ("b", 1)]
    assert sorted(map(tuple, arrivals.compacted(versions, ["k"], str(tmp_path / "whole")).collect())) == [("a", 2), ("b", 1)]


def test_heartbeat_closes_the_last_window(spark, tmp_path):
    rows = [("r", "u", f"e{i}", T0 + i * MIN, "llm.call_end", (None,)) for i in range(30)]
    like, path = spark.createDataFrame(rows, COLS), str(tmp_path / "in")
    files = arrivals.write_arrivals(like, F.floor((F.col("timestamp_ns") - F.lit(T0)) / F.lit(10 * MIN)), 3, path)
    arrivals.heartbeat(spark, like, path, T0 + 1000 * MIN)
    stream = arrivals.arriving(spark, like, path, files, "1 minute")
    windows = arrivals.kept(stream, F.col("event_type") == "llm.call_end").groupBy(F.window("event_time", "10 minutes", "5 minutes").alias("w")).count().select("w.start", "count")
    got = arrivals.run_upserts(windows, str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    assert sum(r["count"] for r in got.collect()) == 60 and got.count() == 7
