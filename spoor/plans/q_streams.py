"""Registered queries: streams that read arrival files to their end and upsert their results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spoor.operators import baselines as B
from spoor.plans.corpus import Corpus, Query, r6
from spoor.plans.q_failure import _DEPTH, _MET, _UNPIV
from spoor.session import _checkpoint_dir
from spoor.sources.tables import with_ctes as W
from spoor.streaming import arrivals as A
from spoor.streaming import depth as D
from spoor.streaming import events as S

SLOTS = 8
HOUR_NS = 3_600_000_000_000
# Arrival of an event in nanoseconds: up to three hours late, and three days where every fiftieth is held up.
SOON = "timestamp_ns + CAST(event_id AS BIGINT) * 7919 % 180 * 60000000000"
HELD = f"CASE WHEN CAST(event_id AS BIGINT) % 50 = 0 THEN timestamp_ns + 72 * {HOUR_NS} ELSE {SOON} END"
SLOT = "CAST(floor(({0} - {1}) * 8 / ({2} - {1} + 1)) AS INT)"
LATENESS_H = 4


def _folder(c: Corpus) -> str:
    return f"{_checkpoint_dir(c.spark)}/streams/{uuid.uuid4().hex}"


def _stream(c: Corpus, arrival: str):
    """The corpus events as arrival files with a heartbeat at their end, read as a stream."""
    events = c.events
    low, high = events.agg(F.min(F.expr(arrival)), F.max(F.expr(arrival))).first()
    slot = F.floor((F.expr(arrival) - F.lit(low)) * 8 / F.lit(high - low + 1))
    path = f"{_folder(c)}/arrivals"
    files = A.write_arrivals(events, slot, SLOTS, path)
    A.heartbeat(c.spark, events, path, high + 1000 * HOUR_NS)
    return A.arriving(c.spark, events, path, files, f"{LATENESS_H} hours")


def _upserts(c: Corpus, stream, mode: str = "update"):
    base = _folder(c)
    key, before = "spark.sql.shuffle.partitions", c.spark.conf.get("spark.sql.shuffle.partitions")
    c.spark.conf.set(key, str(c.spark.sparkContext.defaultParallelism))  # a stream keeps its state partitions for life
    try:
        return A.run_upserts(stream, f"{base}/out", f"{base}/state", mode)
    finally:
        c.spark.conf.set(key, before)


def latency(c: Corpus):
    rows = _upserts(c, S.windowed_latency(_stream(c, SOON), "6 hours", "1 hour"))
    return r6(A.latest(rows, ["window_start"]).select(F.unix_seconds("window_start").alias("start_s"), "mean_latency_ms", "calls"))


def sessions(c: Corpus):
    rows = _upserts(c, S.run_sessions(_stream(c, SOON), "6 hours"), "append")
    return A.latest(rows, ["repo_id", "run_id", "start_ns"]).select("repo_id", "run_id", "events", "errors", "start_ns", "end_ns")


def alerts(c: Corpus):
    base = B.baselines(B.run_metrics(c.events))
    rows = _upserts(c, S.threshold_windows(_stream(c, SOON), base, "1 day"))
    last = A.latest(rows, ["repo_id", "window_start"])
    return r6(last.filter("alert").select("repo_id", F.unix_seconds("window_start").alias("start_s"), "tool_call_failure_rate", "calls"))


def depths(c: Corpus):
    """(depth per run, late steps) of the stream with held-up events, kept once a session."""
    def build():
        base = _folder(c)
        found, late = D.run_depth(_stream(c, HELD), f"{base}/out", f"{base}/state", c.spark.sparkContext.defaultParallelism)
        c.keep("late_steps", lambda: late)
        return D.reconciled(found, c.events)

    return c.keep("stream_depths", build)


def late_steps(c: Corpus):
    depths(c)
    return c.keep("late_steps", lambda: None)


def distinct_reconciled(c: Corpus):
    """Every event once: repeats and late rows leave the stream, and stored events that it did not let through are added."""
    stream = S.distinct_events(_stream(c, HELD).select("repo_id", "event_id", "event_type", "event_time"))
    seen = _upserts(c, A.kept(stream, F.col("event_id").isNotNull()), "append")
    return S.reconciled_events(seen, c.events).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


_STEP = "(event_type IN ('delegation.initiated', 'agent.task_end') OR (event_type = 'agent.task_start' AND coalesce(parent_node, '') <> ''))"
_ARR = (
    f"aa AS (SELECT *, {HELD} AS arrival FROM ev), ab AS (SELECT min(arrival) AS lo, max(arrival) AS hi FROM aa), ac AS (SELECT *, {SLOT.format('arrival', 'lo', 'hi')} AS slot FROM aa, ab), "
    f"wm AS (SELECT s AS slot, (SELECT max(timestamp_ns) // 1000000 FROM ac WHERE ac.slot < s) - {LATENESS_H * 3_600_000} AS passed FROM range({SLOTS}) AS t(s)), "
    f"lt AS (SELECT * FROM ac JOIN wm USING (slot) WHERE {_STEP} AND timestamp_ns // 1000000 <= passed), "
)

ALERTS = W(
    "WITH " + _MET + _UNPIV + "bl AS (SELECT repo_id, least(avg(v) + 2 * stddev_pop(v), 1) AS th FROM lg WHERE metric = 'tool_call_failure_rate' GROUP BY 1), "
    "wd AS (SELECT repo_id, CAST(floor(us / 86400000000) AS BIGINT) * 86400 AS start_s, count(*) FILTER (event_type = 'tool.call_failure') / count(*) AS r, count(*) AS calls FROM ev WHERE event_type IN ('tool.completed', 'tool.call_failure') GROUP BY ALL) "
    "SELECT repo_id, start_s, round(r, 6) AS tool_call_failure_rate, calls FROM wd JOIN bl USING (repo_id) WHERE r > th", "evl")

QUERIES = [
    Query("p2_late_steps", lambda c: late_steps(c).groupBy("repo_id", "run_id").agg(F.count(F.lit(1)).alias("late")), W("WITH " + _ARR.rstrip(", ") + " SELECT repo_id, run_id, count(*) AS late FROM lt GROUP BY ALL", "ev")),
    Query("p2_reconciled_events", distinct_reconciled, W("SELECT event_type, count(*) AS events FROM ev GROUP BY 1", "ev")),
    Query("p5_stream_latency", latency, W(
        "WITH k AS (SELECT CAST(floor(us / 3600000000) AS BIGINT) * 3600 - i * 3600 AS start_s, latency_ms FROM ev, range(6) AS t(i) WHERE event_type = 'llm.call_end' AND latency_ms IS NOT NULL) SELECT start_s, round(avg(latency_ms), 6) AS mean_latency_ms, count(*) AS calls FROM k GROUP BY 1", "ev")),
    Query("p6_stream_sessions", sessions, W(
        "WITH g AS (SELECT *, CASE WHEN timestamp_ns - lag(timestamp_ns) OVER w < 21600000000000 THEN 0 ELSE 1 END AS brk FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY timestamp_ns)), s AS (SELECT *, sum(brk) OVER (PARTITION BY run_id ORDER BY timestamp_ns) AS sess FROM g) "
        "SELECT repo_id, run_id, count(*) AS events, count(*) FILTER (event_type LIKE 'error.%') AS errors, min(timestamp_ns) AS start_ns, max(timestamp_ns) AS end_ns FROM s GROUP BY repo_id, run_id, sess", "ev")),
    Query("p7_stream_alerts", alerts, ALERTS),
    Query("p8_stream_depth", lambda c: depths(c).select("repo_id", "run_id", "max_depth", "from_stream"), W(
        "WITH " + _DEPTH + _ARR + "lr AS (SELECT DISTINCT run_id FROM lt) SELECT mx.*, mx.run_id NOT IN (SELECT run_id FROM lr) AS from_stream FROM mx", "ev")),
]
