"""A corpus Markov model of run states and the chance of reaching an unsafe one.

The Laplace-smoothed matrix is kept sparse: observed counts plus one uniform background per
row, so nothing of size states x states is built beyond what was observed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from spoor.functions.ordered import scan
from spoor.functions.text import nz
from spoor.session import cut

RUN = ["repo_id", "run_id"]


def _role(c: Column) -> Column:
    return F.coalesce(nz(F.get(F.split(c, ":"), 1)), nz(c), F.lit("unknown"))


def state(events: DataFrame) -> Column:
    et = F.col("event_type")
    role = _role(F.col("source_node.node_id"))
    ok = F.col("payload.status").isin("success", "SUCCESS", "completed")
    return (F.when(et == "agent.task_start", F.concat(F.lit("start:"), role)).when((et == "agent.task_end") & ok, F.concat(F.lit("success:"), role)).when(et == "agent.task_end", F.concat(F.lit("fail:"), role))
            .when(et == "delegation.initiated", F.concat(F.lit("delegate:"), role, F.lit("→"), _role(F.col("target_node.node_id")))).when(et.startswith("error."), F.concat(F.lit("error:"), role)))


def sequences(events: DataFrame) -> DataFrame:
    """(repo_id, run_id, event_id, state, next_state) in time order."""
    s = events.select(*RUN, "event_id", "timestamp_ns", state(events).alias("state")).filter("state IS NOT NULL")
    return scan(s, RUN, "timestamp_ns", {"next_state": ("nearest", F.col("state"))}, tie=["event_id"], direction="after")


def unsafe(c: Column) -> Column:
    return c.startswith("error:") | c.startswith("fail:")


def transition_counts(seq: DataFrame) -> DataFrame:
    return seq.filter("next_state IS NOT NULL").groupBy("state", "next_state").agg(F.count(F.lit(1)).alias("n"))


def state_counts(seq: DataFrame) -> DataFrame:
    return seq.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def transitions(seq: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Observed transitions with their smoothed probability and their row's probability of any unseen one."""
    counts = transition_counts(seq)
    rows = state_counts(seq).select("state").join(counts.groupBy("state").agg(F.sum("n").alias("total")), "state", "left").fillna(0)
    size = seq.agg(F.count_distinct("state").alias("s"))
    base = rows.join(F.broadcast(size)).select("state", (F.col("total") + alpha * F.col("s")).alias("den"))  # size is one row
    return counts.join(base, "state").select("state", "next_state", "n", ((F.col("n") + alpha) / F.col("den")).alias("probability"), (alpha / F.col("den")).alias("unseen_probability"))


def violation_probability(seq: DataFrame, horizon: int = 10, alpha: float = 1.0) -> DataFrame:
    """(state, probability): chance of an unsafe state within `horizon` steps, by backward recursion.

    v'(s) = sum_t P(s, t) * w(t), w = 1 on unsafe states and v elsewhere: one vector for all
    start states, instead of one forward distribution per start.
    """
    counts = cut(transition_counts(seq))
    rows = state_counts(seq).select("state").join(counts.groupBy("state").agg(F.sum("n").alias("total")), "state", "left").fillna(0)
    v = cut(rows.withColumn("v", F.lit(0.0)))
    for _ in range(horizon):
        w = v.select(F.col("state").alias("next_state"), F.when(unsafe(F.col("state")), 1.0).otherwise(F.col("v")).alias("w"))
        sums = w.agg(F.sum("w").alias("ws"), F.count(F.lit(1)).alias("s"))
        hit = counts.join(w, "next_state").groupBy("state").agg(F.sum(F.col("n") * F.col("w")).alias("hit"))
        v = cut(v.select("state", "total").join(hit, "state", "left").join(F.broadcast(sums)).select(
            "state", "total", ((F.coalesce("hit", F.lit(0.0)) + alpha * F.col("ws")) / (F.col("total") + alpha * F.col("s"))).alias("v")))
    return v.select("state", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v"))).alias("probability"))


def finding_probabilities(seq: DataFrame, prob: DataFrame, delta: float = 0.05) -> DataFrame:
    """Weighted mean, max and min violation probability over start states, with a Hoeffding bound."""
    n = seq.agg(F.count_distinct(*RUN).alias("sequences"))
    w = prob.filter(F.col("state").startswith("start:")).join(state_counts(seq), "state")
    a = w.agg((F.sum(F.col("probability") * F.col("n")) / F.sum("n")).alias("mean_probability"), F.max("probability").alias("max_probability"), F.min("probability").alias("min_probability"))
    return a.join(F.broadcast(n)).select("mean_probability", "max_probability", "min_probability", F.sqrt(F.lit(math.log(2 / delta)) / (2 * F.greatest("sequences", F.lit(1)))).alias("confidence_bound"))


def top_transitions(t: DataFrame, k: int = 20, above: float = 0.01) -> DataFrame:
    """The k most likely observed transitions (a ranked report)."""
    return t.filter(F.col("probability") > above).orderBy(F.desc(F.round("probability", 9)), "state", "next_state").limit(k)


def riskiest_states(seq: DataFrame, t: DataFrame, k: int = 10, alpha: float = 1.0) -> DataFrame:
    """Safe states by the probability that the next state is unsafe."""
    s = state_counts(seq)
    bad = s.filter(unsafe(F.col("state"))).agg(F.count(F.lit(1)).alias("bad"))
    seen = t.filter(unsafe(F.col("next_state"))).groupBy("state").agg(F.sum("probability").alias("p"), F.count(F.lit(1)).alias("k"))
    den = s.select("state").join(transition_counts(seq).groupBy("state").agg(F.sum("n").alias("total")), "state", "left").fillna(0)
    size = s.agg(F.count(F.lit(1)).alias("s"))
    j = den.filter(~unsafe(F.col("state"))).join(seen, "state", "left").fillna(0).join(F.broadcast(bad)).join(F.broadcast(size))
    risk = F.col("p") + (F.col("bad") - F.col("k")) * alpha / (F.col("total") + alpha * F.col("s"))
    return j.select("state", risk.alias("risk")).orderBy(F.desc(F.round("risk", 9)), "state").limit(k)
