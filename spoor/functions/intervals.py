"""Points in intervals as an equi-join.

An interval of whole numbers is the union of at most two aligned blocks of each size 1, 2, 4, ...; a point
lies in one block of each size. Joining on (key, size, block) finds every pair once, so a pair costs one
row and no interval is compared with points outside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _levels(top: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.greatest(top, F.lit(1)) + 1)), F.lit(1)).cast("int"))


def blocks_of(low: Column, high: Column) -> Column:
    """Aligned blocks (level, number) whose union is [low, high); none if it is empty."""
    def at(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k).cast("long")
        first, end = F.ceil(low / size).cast("long"), F.floor(high / size).cast("long")
        left = F.when((first < end) & (first % 2 == 1), F.struct(k.alias("level"), first.alias("number")))
        right = F.when((first + first % 2 < end) & (end % 2 == 1), F.struct(k.alias("level"), (end - 1).alias("number")))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(_levels(high), at)))


def stab(intervals: DataFrame, points: DataFrame, keys: list[str], low: str, high: str, at: str) -> DataFrame:
    """Rows of `points` joined with every interval of the same keys where low <= at < high; numbers are not negative.

    The sides share no column but `keys`. Null keys or bounds match nothing.
    """
    top = intervals.groupBy(*keys).agg(F.max(high).alias("_top"))
    i = intervals.withColumn("_b", F.explode(blocks_of(F.col(low), F.col(high)))).select(*intervals.columns, F.col("_b.level").alias("_level"), F.col("_b.number").alias("_number"))
    p = points.join(top, keys).withColumn("_level", F.explode(_levels(F.col("_top")))).withColumn("_number", F.floor(F.col(at) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")).drop("_top")
    return p.join(i, [*keys, "_level", "_number"]).drop("_level", "_number")
