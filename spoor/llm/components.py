"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.session import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of a link, and one node that names its component.

    Each round sends a node to the neighbour (or itself) whose hash of that round is least and contracts
    the links along these moves; the links left shrink by a constant factor, and each round is written to
    the checkpoint folder. Links to itself, repeated links and either direction count alike; links with a
    null end are ignored. No links: an empty table.
    """
    left = cut(_links(links.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    roots, turn = None, 0
    while not left.isEmpty():
        rank = lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)).alias("h"), c.alias("n"))
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        best = ends.groupBy("node").agg(F.min(rank(F.col("other"))).alias("best"))
        moves = cut(best.select("node", F.least("best", rank(F.col("node")))["n"].alias("to")))
        if roots is None:
            roots = moves.select("node", F.col("to").alias("root"))
        else:
            roots = cut(roots.join(moves.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        for end in ("a", "b"):
            left = left.join(moves.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}")), end)
        left = cut(_links(left.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))))
        turn += 1
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _links(pairs: DataFrame) -> DataFrame:
    a: Column = F.col("a")
    return pairs.filter(a != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
