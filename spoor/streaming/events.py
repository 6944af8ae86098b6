"""Streaming forms of the event operators.

Every function takes a streaming (or batch) DataFrame of canonical events and returns one, so a
bounded run can be compared with the batch result. Event time comes from `timestamp_ns`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spoor.schema import EVENT
from spoor.streaming.arrivals import kept

LATENESS = "10 minutes"


def event_stream(spark: SparkSession, path: str, *, fmt: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    """Append-only event files as a stream, with event time and watermark."""
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)
    return with_event_time(raw)


def with_event_time(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    timed = events.withColumn("event_time", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("long")))
    return timed.withWatermark("event_time", lateness) if events.isStreaming else timed


def distinct_events(events: DataFrame) -> DataFrame:
    """Drop repeats of an event id that arrive within the watermark."""
    keys = ["repo_id", "event_id"]
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def windowed_latency(events: DataFrame, width: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Mean latency of completed model calls over a sliding window."""
    calls = kept(events, (F.col("event_type") == "llm.call_end") & F.col("payload.latency_ms").isNotNull())
    return calls.groupBy(F.window("event_time", width, slide).alias("w")).agg(F.avg("payload.latency_ms").alias("mean_latency_ms"), F.count(F.lit(1)).alias("calls")).select(
        F.col("w.start").alias("window_start"), "mean_latency_ms", "calls")


def run_sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Per run and burst of activity: events, errors and span, closed after a gap."""
    return kept(events, F.col("run_id").isNotNull()).groupBy("repo_id", "run_id", F.session_window("event_time", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type").startswith("error.")).alias("errors"), F.min("timestamp_ns").alias("start_ns"), F.max("timestamp_ns").alias("end_ns")
    ).select("repo_id", "run_id", F.col("s.start").alias("session_start"), "events", "errors", "start_ns", "end_ns")


def call_pairs(events: DataFrame, within: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Start and end of a call joined by parent id; both sides are bounded in time, so state is too."""
    s = events.filter(F.col("event_type").isin("agent.task_start", "tool.invoked", "llm.call_start", "execution.start", "delegation.initiated"))
    e = events.filter(F.col("event_type").isin("agent.task_end", "tool.completed", "llm.call_end", "execution.end", "delegation.completed") & F.col("parent_event_id").isNotNull())
    s = s.select(F.col("repo_id").alias("s_repo"), F.col("run_id").alias("s_run"), F.col("event_id").alias("s_id"), F.col("event_time").alias("s_time"), F.col("timestamp_ns").alias("s_ns"))
    e = e.select("repo_id", "run_id", "event_id", "event_type", "parent_event_id", "event_time", "timestamp_ns")
    on = F.expr(f"repo_id = s_repo AND run_id = s_run AND parent_event_id = s_id AND event_time >= s_time AND event_time <= s_time + {within}")
    return e.join(s, on).select("repo_id", "run_id", "event_id", "event_type", (F.col("timestamp_ns") - F.col("s_ns")).alias("latency_ns"))


def threshold_windows(events: DataFrame, baselines: DataFrame, width: str = "1 hour") -> DataFrame:
    """Every window's error share of tool calls beside the repository's baseline threshold (stream-static join).

    Windows without an alert are rows too: a later version of a window must be able to take an alert back.
    """
    et = F.col("event_type")
    t = kept(events, et.isin("tool.completed", "tool.call_failure")).groupBy("repo_id", F.window("event_time", width).alias("w")).agg(
        (F.count_if(et == "tool.call_failure") / F.count(F.lit(1))).alias("tool_call_failure_rate"), F.count(F.lit(1)).alias("calls"))
    lim = baselines.filter("metric = 'tool_call_failure_rate'").select("repo_id", "suggested_threshold")
    over = F.col("tool_call_failure_rate") > F.col("suggested_threshold")
    return t.join(lim, "repo_id").select("repo_id", F.col("w.start").alias("window_start"), "tool_call_failure_rate", "calls", "suggested_threshold", over.alias("alert"))


def threshold_alerts(events: DataFrame, baselines: DataFrame, width: str = "1 hour") -> DataFrame:
    """The windows of `threshold_windows` that are above their threshold."""
    return threshold_windows(events, baselines, width).filter("alert").drop("alert")


def reconciled_events(streamed: DataFrame, stored: DataFrame) -> DataFrame:
    """repo_id, event_id, event_type, from_stream: what the stream let through, and stored events that it dropped as late."""
    keys = ["repo_id", "event_id"]
    seen = streamed.select(*keys, "event_type").dropDuplicates(keys).withColumn("from_stream", F.lit(True))
    missed = stored.select(*keys, "event_type").dropDuplicates(keys).join(seen.select(*keys), keys, "left_anti")
    return seen.unionByName(missed.withColumn("from_stream", F.lit(False)))


def _depth(key: tuple, batches, state: GroupState):
    """Running delegation depth of one run; the state is two integers, dropped ten minutes of
    event time after the run's last event."""
    if state.hasTimedOut:
        state.remove()
        return
    current, top = state.get if state.exists else (0, 0)
    rows = pd.concat(list(batches)).sort_values(["timestamp_ns", "event_id"])
    for up in rows["step"]:
        current = max(0, current + int(up))
        top = max(top, current)
    state.update((current, top))
    state.setTimeoutTimestamp(max(int(rows["timestamp_ns"].max()) // 1_000_000, state.getCurrentWatermarkMs()) + 600_000)
    yield pd.DataFrame({"repo_id": [key[0]], "run_id": [key[1]], "depth": [current], "max_depth": [top]})


def running_depth(events: DataFrame) -> DataFrame:
    """Delegation depth per run as events arrive (update mode)."""
    et = F.col("event_type")
    up = (et == "delegation.initiated") | ((et == "agent.task_start") & F.col("payload.parent_node_id").isNotNull())
    steps = events.select("repo_id", "run_id", "event_id", "timestamp_ns", "event_time", F.when(up, 1).when(et == "agent.task_end", -1).alias("step")).filter("step IS NOT NULL")
    out = "repo_id string, run_id string, depth long, max_depth long"
    return steps.groupBy("repo_id", "run_id").applyInPandasWithState(_depth, out, "current long, top long", "update", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, target: str, checkpoint: str, partitions: int | None = None) -> DataFrame:
    """Process what is there, write Parquet, stop, and read the result back.

    A stream keeps its number of state partitions for life; `partitions` sets it for this one
    (for a backfill, the cluster's cores), otherwise the session's shuffle setting holds.
    """
    spark = stream.sparkSession
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        if partitions:
            spark.conf.set(key, str(partitions))
        q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(target)
