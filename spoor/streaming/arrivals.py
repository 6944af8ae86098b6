"""Running event streams to their end: arrival files, heartbeats, idempotent upserts, late rows.

A stream that stops has not closed its last windows, because only later events move the watermark. A
heartbeat (a row with an event time and no repository) moves it. Results are written per micro-batch under
its number, so a batch that is run again replaces itself; the latest version of a key is the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spoor.session import land

ROWS_PER_FILE = 1_000_000
BATCH = "_batch"


def write_arrivals(events: DataFrame, slot: Column, slots: int, path: str) -> int:
    """Write `events` as `slots` groups of files, group 0 (by `slot`) first; returns files per group.

    A reader that takes that many files a trigger sees one group after another.
    """
    numbered = land(events.withColumn("_slot", F.least(F.greatest(slot, F.lit(0)), F.lit(slots - 1)).cast("int")), "arrivals")
    most = numbered.groupBy("_slot").count().agg(F.max("count")).first()[0] or 0
    files = max(1, -(-most // ROWS_PER_FILE))
    for i in range(slots):
        numbered.filter(F.col("_slot") == i).drop("_slot").repartition(files).write.mode("append").parquet(path)
    return files


def heartbeat(spark: SparkSession, like: DataFrame, path: str, timestamp_ns: int) -> None:
    """One row that only has a time, written as the next arrival."""
    row = spark.range(1).select(*[(F.lit(timestamp_ns) if f.name == "timestamp_ns" else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])
    row.coalesce(1).write.mode("append").parquet(path)


def arriving(spark: SparkSession, like: DataFrame, path: str, files: int, lateness: str) -> DataFrame:
    """The arrival files as a stream with `event_time` and its watermark."""
    raw = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn("event_time", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("long"))).withWatermark("event_time", lateness)


def kept(events: DataFrame, condition: Column) -> DataFrame:
    """Filter rows of a stream after they have moved the watermark.

    Spark moves a filter below the watermark unless it uses the event time, and rows left out there, heartbeats
    above all, would not move it.
    """
    return events.filter(F.when(F.col("event_time").isNotNull(), condition) if "event_time" in events.columns else condition)


def to_versions(target: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch under its number, replacing what an earlier attempt left."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{BATCH}={number}")

    return write


def run_upserts(stream: DataFrame, target: str, checkpoint: str, mode: str) -> DataFrame:
    """Run what is there to its end; the rows of all batches with the batch number in `_batch`."""
    q = stream.writeStream.foreachBatch(to_versions(target)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark, schema = stream.sparkSession, stream.schema
    return spark.read.schema(schema.add(BATCH, "long")).option("basePath", target).parquet(target)


def latest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch; keys compare null-safe."""
    names = [c for c in versions.columns if c != BATCH]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*names), BATCH).alias("r")).select("r.*")


def compacted(versions: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Write the latest version of every key as a table of its own and read it."""
    latest(versions, keys).write.mode("overwrite").parquet(target)
    return versions.sparkSession.read.schema(versions.drop(BATCH).schema).parquet(target)


