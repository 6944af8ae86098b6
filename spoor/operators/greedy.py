"""Greedy selection by marginal value with lazy scores.

The value of a candidate can only fall as others are picked, so its value at an earlier time is an upper
bound. Candidates are stored sorted by that bound; a round scores the best bounds again, and only those
above the worst of its picks can be better, so the others are neither read nor scored. When a round has
to look far down, all bounds are renewed. Picks are a table that each round adds to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spoor.session import land

BLOCK = 4096
RENEW_SHARE = 0.25


def lazy_greedy(pool: DataFrame, target: int, batches: Callable[[int], int], value: Callable[[dict[str, int]], Column], counters: Callable[[DataFrame], DataFrame], used: str, *, block: int = BLOCK, on_round: Callable[[int, int], None] | None = None) -> DataFrame:
    """(repo_id, pick): the best `batches(n)` by `value` with n picked, ties by repo_id, until `target`.

    value(counts) must not rise when counts rise; it may use the column `_seen`: whether an earlier pick has the row's
    non-null value in column `used`. counters(rows) gives (key, n), a bounded set of keys, for rows just picked.
    `on_round(read, total)` is told how many candidates a round scored. repo_id must be unique.
    """
    counts: dict[str, int] = {}
    picks = pool.select("repo_id", used).limit(0).withColumn("pick", F.lit(0).cast("long"))

    def scored(rows: DataFrame) -> DataFrame:
        seen = picks.select(used).dropna().distinct().withColumn("_seen", F.lit(True))
        left = rows.join(picks.select("repo_id"), "repo_id", "left_anti").join(seen, used, "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
        return left.withColumn("_value", F.round(value(counts), 9))

    def bounds(rows: DataFrame) -> tuple[DataFrame, float | None]:
        """Candidates by descending bound, each file one range of it, and the bound of the last of the first block."""
        out = scored(rows).withColumnRenamed("_value", "bound").drop("_seen").repartitionByRange(F.desc("bound")).sortWithinPartitions(F.desc("bound"))
        out = land(out, "bounds")
        return out, out.orderBy(F.desc("bound")).limit(block).agg(F.min("bound")).first()[0]

    candidates, low = bounds(pool)
    total = candidates.count()
    done, best_first = 0, [F.desc("_value"), F.col("repo_id")]
    while done < min(target, total):
        want = min(batches(done), target - done)
        near = scored(candidates.filter(F.col("bound") >= low))
        now = land(near.orderBy(*best_first).limit(want), "greedy_round")
        got, worst = now.agg(F.count(F.lit(1)), F.min("_value")).first()
        if got < want or worst < low:
            # Someone beyond the block may be better than the last pick, but nobody whose bound is below its value.
            near = scored(candidates if got < want else candidates.filter(F.col("bound") >= worst))
            now = land(near.orderBy(*best_first).limit(want), "greedy_round")
            got = now.count()
        read = near.count()
        if on_round:
            on_round(read, total)
        if not got:
            break
        place = F.row_number().over(W.orderBy(*best_first)) + done  # one round's picks
        picks = land(picks.unionByName(now.select("repo_id", used, place.cast("long").alias("pick"))), "greedy_picks")
        for r in counters(now).collect():
            counts[r["key"]] = counts.get(r["key"], 0) + r["n"]
        done += got
        if read > max(2 * block, RENEW_SHARE * total):
            candidates, low = bounds(candidates.drop("bound"))
    return picks.select("repo_id", "pick")
