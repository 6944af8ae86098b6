"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Among all document rates that meet every source's token target and stay within [0, cap], the ones nearest
to 1 in Kullback-Leibler divergence are min(cap, exp(lambda * size / mean size)), one lambda per source.
The convex dual is solved by Newton steps, kept inside a bracket, over counts per (source, size): the
corpus is read once, and a source with a third of all rows is summed before it is shuffled. Rates become
whole copies by running sums over bounded chunks of each source; a few passes over each chunk then take up
what rounding left over, with the largest documents that fit, every third time with the smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.session import land

WEIGHTS = (5.0, 2.0, 1.0)
CHUNK_ROWS = 4000
UNIT = 1_000_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, sid, n_rows, source_size, mean, target) per source of (source, size, n).

    Sources take the weights in code-point order, null last, repeating; together they are to get `budget`
    times all sizes. Where that is above `cap` times a source's size, the excess is shared anew by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")).alias("squares"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    per = per.withColumn("sid", F.row_number().over(order))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("fills", F.col("most") / F.col("weight"))
    fill = Window.orderBy("fills", "sid")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    per = per.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "sid", "level"))).over(everything)["level"])
    target = F.coalesce(F.least("most", F.col("weight") * F.col("level")), F.col("most"))
    mean = F.coalesce(F.try_divide(F.col("squares"), F.col("source_size").cast("double")), F.lit(1.0))
    return per.select("source", "sid", "n_rows", "source_size", mean.alias("mean"), target.alias("target"), (target >= F.col("most") * (1 - 1e-12)).alias("full"))


def solve_rates(sizes: DataFrame, sources: DataFrame, cap: float = 2.0, steps: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """(sid, lam) per source: Newton iterations on the dual, all sources at once; each step is written out."""
    hist = land(sizes.join(sources.select("source", "sid"), sizes["source"].eqNullSafe(sources["source"])).select("sid", "size", "n"), "mix_sizes")
    inf = float("inf")
    state = land(sources.filter("not full").select("sid", "mean", "target", F.lit(0.0).alias("lam"), F.lit(-inf).alias("low"), F.lit(inf).alias("high")), "mix_state")
    for _ in range(steps):
        z = F.col("size") / F.col("mean")
        free = F.exp(F.least(F.col("lam") * z, F.lit(700.0)))
        words = F.col("n") * F.col("size") * F.least(free, F.lit(float(cap)))
        slope = F.when(free < cap, F.col("n") * F.col("size") * z * free).otherwise(0.0)
        sums = hist.join(state.select("sid", "mean", "lam"), "sid").groupBy("sid").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        now = state.join(sums, "sid", "left").withColumn("gap", F.coalesce("words", F.lit(0.0)) - F.col("target"))
        low = F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("gap") >= 0, F.col("lam")).otherwise(F.col("high"))
        now = now.withColumns({"low": low, "high": high})
        newton = F.col("lam") - F.try_divide(F.col("gap"), F.col("slope"))
        middle = F.when(F.col("low") == -inf, F.col("high") * 2 - 1).when(F.col("high") == inf, F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        met = F.abs("gap") <= F.col("target") * tolerance
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        state = land(now.select("sid", "mean", "target", F.when(met, F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"), "low", "high", met.alias("met")), "mix_state")
        if state.filter("not met").isEmpty():
            break
    return state.select("sid", "lam")


def mix(rows: DataFrame, size: str, source: str, key: str, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0, chunk_rows: int = CHUNK_ROWS, passes: int = 6) -> DataFrame:
    """`rows` with source_size, target, rate, copies and taken (copies times size).

    `size` is a non-null long, `source` a string that may be null (a source of its own), `key` a non-null long
    that breaks ties; equal rows get copies as a set. Rows of size 0 keep a rate of 1 and take nothing; a
    source of size 0 has target 0. `rows` is read several times, so pass a stored table with narrow rows.
    Columns with the names of the result are replaced. An empty table stays empty.
    """
    sizes = land(rows.groupBy(F.col(source).alias("source"), F.col(size).alias("size")).agg(F.count("*").alias("n")), "mix_counts")
    sources = land(source_targets(sizes, weights, budget, cap), "mix_sources")
    lam = solve_rates(sizes, sources, cap)
    plan = land(sources.join(lam, "sid", "left"), "mix_plan")
    kept = [c for c in rows.columns if c.lower() not in ("source_size", "target", "rate", "copies", "taken")]
    body = rows.select(F.struct(*kept).alias("row"), F.col(size).alias("size"), F.col(source).alias("source"), F.col(key).alias("key"))
    body = body.join(plan.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.exp(F.col("lam") * F.col("size") / F.col("mean")), F.lit(float(cap))))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce(rate, F.lit(1.0)))
    chunks = F.ceil(F.col("n_rows") / chunk_rows)
    body = body.withColumns({"rate": rate, "chunks": chunks, "chunk": F.pmod(F.xxhash64("key", F.lit("chunk")), chunks)})
    units = F.round(F.col("rate") * UNIT).cast("long")
    ranks = Window.partitionBy("sid", "chunk").orderBy(F.desc("size"), "key")
    run = F.sum(units).over(ranks.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(UNIT // 2)
    copies = F.least(F.floor(run / UNIT) - F.floor((run - units) / UNIT), F.ceil(F.lit(cap)))
    body = land(body.withColumn("copies", copies.cast("long")).drop("lam", "mean", "n_rows"), "mix_rounded")
    for turn in range(passes):
        left = body.groupBy("sid").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
        left = land(left.withColumn("near", F.abs("left") <= F.lit(1.0)), "mix_left")
        if left.filter("not near").isEmpty():
            break
        share = F.abs("left") / F.col("chunks")
        able = (F.col("size") > 0) & (F.col("size") <= share) & F.when(F.col("left") > 0, F.col("copies") + 1 <= cap).otherwise(F.col("copies") > 0)
        first = F.col("size") if turn % 3 == 2 else F.desc("size")
        ranks = Window.partitionBy("sid", "chunk").orderBy(first, "key").rowsBetween(Window.unboundedPreceding, 0)
        used = F.sum(F.when(able, F.col("size")).otherwise(0)).over(ranks)
        step = F.when(able & (used <= share), F.signum("left")).otherwise(0).cast("long")
        body = land(body.join(left, "sid").withColumn("step", step).withColumn("copies", F.col("copies") + F.col("step")).drop("left", "near", "step"), "mix_rounded")
    return body.select("row.*", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
