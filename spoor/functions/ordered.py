"""Ordered computations (running sums, nearest neighbours) that survive hot keys.

A plain `Window.partitionBy(key).orderBy(ts)` sorts every row of one key in one task. A run
that holds a third of all rows would pin that third to one executor. Here the rows of keys with
more than `rows_per_bucket` rows are range-partitioned by (key, order, tie) on sampled bounds, so
each range holds about that many rows however bursty the order values are; the window runs per
(key, range), and a summary per range carries the state on. Results equal the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spoor.session import land

ROWS_PER_BUCKET = 1_000_000


def _fold(kind: str, col: Column) -> Column:
    if kind == "nearest":
        return F.last(col, ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](col)


def order_ranges(rows: DataFrame, keys: list[str], order: str, tie: list[str], n_rows: int, limit: int) -> DataFrame:
    """`rows` with the number `_b` of their range, ascending in (keys, order, tie); about `limit` rows a range.

    Stored, because a range number must not change between its uses.
    """
    split = rows.repartitionByRange(-(-n_rows // limit), *keys, order, *tie)
    return land(split.withColumn("_b", F.spark_partition_id()), "order_ranges")


def _scan_hot(rows: DataFrame, keys: list[str], order: str, kinds: dict[str, str], tie: list[str], asc: bool, last: int, n_rows: int, limit: int) -> DataFrame:
    """Columns `_w_<name>` folded over (keys, order, tie), which is a total order, range by range."""
    split = order_ranges(rows, keys, order, tie, n_rows, limit)
    point = F.struct(order, *tie)
    pick = F.max_by if asc else F.min_by

    def total(kind: str, col: Column) -> Column:
        return pick(col, F.when(col.isNotNull(), point)) if kind == "nearest" else _fold(kind, col)

    def direct(name: str) -> Column:
        return F.col(name).asc() if asc else F.col(name).desc()

    inner = W.partitionBy(*keys, "_b").orderBy(*map(direct, [order, *tie])).rowsBetween(W.unboundedPreceding, last)
    out = split.select("*", *[_fold(k, F.col(f"_in_{n}")).over(inner).alias(f"_w_{n}") for n, k in kinds.items()])
    sums = split.groupBy(*keys, "_b").agg(*[total(k, F.col(f"_in_{n}")).alias(f"_t_{n}") for n, k in kinds.items()])
    outer = W.partitionBy(*keys).orderBy(direct("_b")).rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(*keys, "_b", *[_fold(k, F.col(f"_t_{n}")).over(outer).alias(f"_c_{n}") for n, k in kinds.items()])

    def merge(name: str, kind: str) -> Column:
        here, before = F.col(f"_w_{name}"), F.col(f"_c_{name}")
        both = {"sum": F.coalesce(here + before, here, before), "min": F.least(here, before), "max": F.greatest(here, before)}
        return both.get(kind, F.coalesce(here, before)).alias(f"_w_{name}")

    return out.join(carry, [*keys, "_b"], "left").select(*rows.columns, *[merge(n, k) for n, k in kinds.items()])


def scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    specs: dict[str, tuple[str, Column]],
    *,
    tie: list[str] | None = None,
    direction: str = "before",
    inclusive: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    stored: bool = False,
) -> DataFrame:
    """Add one column per spec, folded over the rows before (or after) each row of its key.

    specs maps name -> (kind, column); kind is sum, min, max or nearest (closest non-null).
    Without `tie` the frame is by value: rows with an equal order value are on neither side
    (inclusive adds them). With `tie` columns the order is total and the frame is by row.
    The input is evaluated once and stored, unless the caller says that it is `stored` already.
    """
    asc, kinds = direction == "before", {name: kind for name, (kind, _) in specs.items()}
    rows = df.select("*", *[col.alias(f"_in_{name}") for name, (_, col) in specs.items()])
    rows = rows if stored else land(rows, "ordered")
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_bucket)
    n_hot = hot.agg(F.sum("_n")).first()[0]
    hot = hot.select(*keys)

    direct = (lambda c: F.col(c).asc()) if asc else (lambda c: F.col(c).desc())
    w = W.partitionBy(*keys).orderBy(direct(order), *[direct(t) for t in tie or []])
    last = W.currentRow if inclusive else -1
    w = w.rangeBetween(W.unboundedPreceding, last) if tie is None else w.rowsBetween(W.unboundedPreceding, last)
    cold = rows.join(hot, keys, "left_anti") if n_hot else rows
    out = cold.select("*", *[_fold(k, F.col(f"_in_{n}")).over(w).alias(f"_w_{n}") for n, k in kinds.items()])
    if n_hot:
        mine = rows.join(hot, keys, "left_semi")
        if tie is not None:
            done = _scan_hot(mine, keys, order, kinds, tie, asc, last, n_hot, rows_per_bucket)
        else:
            # one point per value, so that rows sharing a value need not share a range
            points = mine.groupBy(*keys, order).agg(*[_fold(k, F.col(f"_in_{n}")).alias(f"_in_{n}") for n, k in kinds.items()])
            done = _scan_hot(points, keys, order, kinds, [], asc, last, n_hot, rows_per_bucket)
            done = done.select(*keys, F.col(order).alias("_at"), *[f"_w_{n}" for n in kinds])
            done = mine.withColumn("_at", F.col(order)).join(done, [*keys, "_at"], "left").drop("_at")
        out = out.unionByName(done)

    def result(name: str, kind: str) -> Column:
        col = F.col(f"_w_{name}")
        return (F.coalesce(col, F.lit(0)) if kind == "sum" else col).alias(name)

    return out.select(*[c for c in df.columns if c not in specs], *[result(n, k) for n, k in kinds.items()])


def _ranked_values(df: DataFrame, keys: list[str], value: str, rows_per_bucket: int) -> DataFrame:
    """Distinct values per key with their count `_cnt`, the rows `_before` them and the key's `_total`."""
    counted = land(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt")), "value_counts")
    ranked = scan(counted, keys, value, {"_before": ("sum", F.col("_cnt"))}, tie=[], rows_per_bucket=rows_per_bucket, stored=True)
    return ranked.join(counted.groupBy(*keys).agg(F.sum("_cnt").alias("_total")), keys)


def percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], *, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Exact linearly interpolated percentiles per key, without holding a key in one task.

    Values are counted first (map-side combined), then ranked with the range-cut running sum.
    """
    joined = _ranked_values(df, keys, value, rows_per_bucket)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda rank: (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_cnt"))
        aggs += [
            F.max(F.when(at(lo), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(at(hi), F.col(value))).alias(f"_hi_{name}"),
        ]
    wide = joined.groupBy(*keys).agg(F.max("_total").alias("_total"), *aggs)
    def interpolate(name: str, p: float) -> Column:
        pos = F.lit(p) * (F.col("_total") - 1)
        return F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (pos - F.floor(pos))
    return wide.select(*keys, *[interpolate(n, p).alias(n) for n, p in probs.items()])


def element_at_rank(df: DataFrame, keys: list[str], value: str, rank: Column, name: str,
                    *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The value at a 0-based rank of each key; `rank` may use the column `_total`."""
    ranked = _ranked_values(df, keys, value, rows_per_bucket)
    hit = (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_cnt"))
    return ranked.filter(hit).select(*keys, F.col(value).alias(name))
