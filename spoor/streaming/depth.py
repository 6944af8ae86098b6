"""Delegation depth per run over a stream whose rows come out of order.

A step (+1 for a delegation, -1 for a finished task, never below zero) counts in the order of event time,
so steps wait in the run's state until the watermark has passed them; a timer folds what is due. A step that
arrives behind the watermark cannot be put in order any more: it leaves the operator as a late row. A batch
pass afterwards counts runs with late or still waiting rows anew; all others keep what the stream found.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spoor.functions.ordered import scan
from spoor.functions.text import nz
from spoor.streaming.arrivals import BATCH, kept, latest, run_upserts

RUN = ["repo_id", "run_id"]
OUT = "kind string, repo_id string, run_id string, event_id string, timestamp_ns long, depth long, max_depth long, steps long"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def steps(events: DataFrame) -> DataFrame:
    """repo_id, run_id, event_id, timestamp_ns, step of the events that change the depth."""
    et = F.col("event_type")
    up = (et == "delegation.initiated") | ((et == "agent.task_start") & nz(F.col("payload.parent_node_id")).isNotNull())
    some = kept(events, (up | (et == "agent.task_end")) & F.col("timestamp_ns").isNotNull())
    return some.select(*RUN, "event_id", "timestamp_ns", F.when(up, 1).otherwise(-1).cast("int").alias("step"))


class DepthInOrder(StatefulProcessor):
    """State of one run: waiting steps, the folded depth, and the time its timer is set to.

    The steps are a list that is appended to and replaced as a whole, as each call for a single row is a
    round trip between Python and the state store.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "timestamp_ns long, event_id string, step int")
        self.folded = handle.getValueState("folded", "depth long, max_depth long, steps long")
        self.timer = handle.getValueState("timer", "at_ms long")

    def _wake(self, at_ms: int) -> None:
        set_to = self.timer.get()[0] if self.timer.exists() else None
        if set_to is None or at_ms < set_to:
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(at_ms)
            self.timer.update((at_ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        first, new = None, []
        for r in rows:
            at_ms = r.timestamp_ns // 1_000_000
            if at_ms <= passed:
                yield Row(kind="late", repo_id=key[0], run_id=key[1], event_id=r.event_id, timestamp_ns=r.timestamp_ns, depth=None, max_depth=None, steps=None)
            else:
                new.append((r.timestamp_ns, r.event_id, r.step))
                first = at_ms if first is None else min(first, at_ms)
        if new:
            self.waiting.appendList(new)
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        due, rest = [], []
        for (ns, event), step in {(ns, event): step for ns, event, step in self.waiting.get()}.items():  # a repeated step counts once
            (due if ns // 1_000_000 <= passed else rest).append((ns, event, step))
        depth, top, n = self.folded.get() if self.folded.exists() else (0, 0, 0)
        for ns, event, step in sorted(due):
            depth = max(0, depth + step)
            top = max(top, depth)
        self.folded.update((depth, top, n + len(due)))
        if rest:
            self.waiting.put(rest)
            self._wake(min(ns for ns, _, _ in rest) // 1_000_000)
        else:
            self.waiting.clear()
        yield Row(kind="depth", repo_id=key[0], run_id=key[1], event_id=None, timestamp_ns=None, depth=depth, max_depth=top, steps=n + len(due))

    def close(self) -> None:
        pass


def depth_stream(events: DataFrame) -> DataFrame:
    """Rows of kind 'depth' (a run's depth so far) and 'late' (a step behind the watermark), in update mode.

    `events` has a watermark. Its column goes no further than here, so that Spark leaves late rows to the processor.
    """
    return steps(events).groupBy(*RUN).transformWithState(statefulProcessor=DepthInOrder(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def batch_depth(events: DataFrame) -> DataFrame:
    """repo_id, run_id, depth, max_depth, steps per run, over all events at once."""
    s = steps(events)
    cum = scan(s, RUN, "timestamp_ns", {"cum": ("sum", F.col("step"))}, tie=["event_id"], inclusive=True)
    low = scan(cum, RUN, "timestamp_ns", {"low": ("min", F.col("cum"))}, tie=["event_id"], inclusive=True)
    here = F.col("cum") - F.least(F.lit(0), F.col("low"))
    at = F.struct("timestamp_ns", "event_id")
    return low.groupBy(*RUN).agg(F.max_by(here, at).alias("depth"), F.max(here).alias("max_depth"), F.count(F.lit(1)).alias("steps"))


def run_depth(stream: DataFrame, target: str, checkpoint: str, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Run the stream to its end: (depth per run with the steps it counts, late rows)."""
    spark = stream.sparkSession
    wanted = dict([STORE]) | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        rows = run_upserts(depth_stream(stream), target, checkpoint, "update")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    depths = latest(rows.filter("kind = 'depth'").select(*RUN, "depth", "max_depth", "steps", BATCH), RUN)
    return depths, rows.filter("kind = 'late'").select(*RUN, "event_id", "timestamp_ns", F.col(BATCH).alias("batch"))


def reconciled(depths: DataFrame, events: DataFrame) -> DataFrame:
    """Depth per run, exact: runs whose stored events hold other steps than the stream counted are counted anew.

    `from_stream` tells which rows are the stream's.
    """
    stored = steps(events).groupBy(*RUN).agg(F.count(F.lit(1)).alias("stored"))
    known = stored.join(depths, RUN, "left").withColumn("from_stream", F.coalesce(F.col("steps") == F.col("stored"), F.lit(False)))
    again = known.filter("NOT from_stream").select(*RUN)
    fresh = batch_depth(events.join(again, RUN, "left_semi")).withColumn("from_stream", F.lit(False))
    names = [*RUN, "depth", "max_depth", "steps", "from_stream"]
    return known.filter("from_stream").select(*names).unionByName(fresh.select(*names))
