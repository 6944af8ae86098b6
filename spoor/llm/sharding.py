"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records are dealt into the ranges between
them, many ranges per shard. Ranges are then measured exactly, overfull ones are subdivided by a second
hash (one key may hold a third of all rows), and the pieces go largest first to the emptiest shard.
Sample, ranges and pieces are bounded by the parameters, never by the data.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import fresh

RANGES_PER_SHARD = 64
SAMPLE_PER_RANGE = 12


def _splitters(sample: pd.DataFrame, ranges: int) -> np.ndarray:
    sample = sample.sort_values("key")
    filled = sample["weight"].cumsum().to_numpy()
    at = np.searchsorted(filled, np.arange(1, ranges) * (filled[-1] / ranges)) if len(filled) else []
    return np.unique(sample["key"].to_numpy(np.int64)[np.minimum(at, len(sample) - 1)]) if len(filled) else np.zeros(0, np.int64)


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are not above the key, by binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    table, span = F.lit(cuts), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        above, inside = F.get(table, middle) > key, s["lo"] < s["hi"]
        return F.struct(F.when(inside & ~above, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(inside & above, middle).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), span, halve, lambda s: s["lo"])


def place(pieces: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(piece, shard, first slot) for pieces (piece, bytes, rows): largest first to the emptiest shard."""
    loads = [(0, 0, s) for s in range(shards)]
    out = []
    for piece, size, rows in sorted(pieces, key=lambda p: (-p[1], p[0])):
        load, used, shard = heapq.heappop(loads)
        out.append((piece, shard, used))
        heapq.heappush(loads, (load + size, used + rows, shard))
    return out


def shard(rows: DataFrame, size: str, key: str, tie: str, shards: int = 24, ranges_per_shard: int = RANGES_PER_SHARD, sample_per_range: int = SAMPLE_PER_RANGE) -> DataFrame:
    """`rows` with `shard` (0 to shards - 1) and `slot` (gapless from 0 within the shard); sizes come near equal.

    `size`, `key` and `tie` name non-null long columns; rows with equal keys stay in one range unless it is
    overfull. Rows are read several times, so pass a table that is stored. Equal rows may swap slots, which
    leaves the result as a set unchanged. Columns named shard or slot are replaced. An empty table stays empty.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(size)).first()[0] or 0
    ranges = shards * ranges_per_shard
    step = max(1.0, total / (ranges * sample_per_range))
    draw = F.pmod(F.xxhash64(key, tie, F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.filter(draw < F.col(size) / step).select(F.col(key).alias("key"), F.greatest(F.col(size).cast("double"), F.lit(step)).alias("weight")).toPandas()
    cuts = _splitters(sample, ranges)

    part, piece, first, count, home, slot0, slot1 = (fresh(rows, c) for c in ("range_no", "piece_no", "first_piece", "piece_count", "shard_no", "first_slot", "slot_no"))
    dealt = rows.withColumn(part, _range_of(F.col(key), cuts.tolist()))
    limit = max(1, 2 * total // ranges)
    base = 0
    plan = []
    for r in dealt.groupBy(part).agg(F.sum(size).alias("b")).orderBy(part).collect():  # at most `ranges` rows
        n = max(1, -(-r["b"] // limit))
        plan.append((r[part], base, n))
        base += n
    wide = spark.createDataFrame(plan or [(0, 0, 1)], f"`{part}` int, `{first}` int, `{count}` int")
    dealt = dealt.join(F.broadcast(wide), part).withColumn(piece, F.col(first) + F.pmod(F.xxhash64(tie, F.lit("piece")), F.col(count)).cast("int")).drop(part, first, count)
    measured = dealt.groupBy(piece).agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect()  # at most 1.5 times `ranges` rows
    homes = place([(r[piece], r["b"], r["n"]) for r in measured], shards)
    homes_df = spark.createDataFrame(homes or [(0, 0, 0)], f"`{piece}` int, `{home}` int, `{slot0}` long")
    order = Window.partitionBy(piece).orderBy(key, tie)
    out = dealt.withColumn(slot1, F.row_number().over(order) - 1).join(F.broadcast(homes_df), piece)
    keep = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    return out.select(*keep, F.col(home).alias("shard"), (F.col(slot0) + F.col(slot1)).cast("long").alias("slot"))
