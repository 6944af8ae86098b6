"""Corpus preparation: five stages from raw documents to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import decontaminate, mixing, sharding, simhash, toxicity
from spoor.llm.common import fresh, word_count
from spoor.llm.queries import table
from spoor.session import land, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay; the model is fitted on the labelled rows of the given documents.

    Null and empty texts score low and stay, repeated rows stay or go together, no rows in give none out.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = fresh(docs, "toxicity")
    return toxicity.score(docs, "text", model, out).filter(F.col(out) < 0.5).drop(out)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id (null ids last, ties: the first read).

    Texts without words share one fingerprint and so one group; no rows in give none out.
    """
    return simhash.keep_one_per_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay, null and empty texts among them; repeated rows stay or go together."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def _hashable(docs: DataFrame) -> list:
    """Every column with its null mark, nested ones as JSON, so that different rows hash apart."""
    out = []
    for name, kind in docs.dtypes:
        col = F.to_json(F.struct(name)) if kind.startswith(("array", "map", "struct")) else F.col(name)
        out += [F.col(name).isNull(), col]
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is repeated as often as the mix takes it (0 to 2 times); no rows in, none out.

    Narrow rows decide one by one. Rows that are equal in every column are one text with several decisions, so their
    copies are summed, never rounded again. A null source is a source; null and empty texts have size 0, are kept once,
    and take nothing of a target. Texts are shuffled once, to meet their decisions.
    """
    key, tie, copies, row = (fresh(docs, c) for c in ("row_key", "row_tie", "copies", "whole_row"))
    marks = _hashable(docs)
    keyed = docs.withColumns({key: F.xxhash64(*marks), tie: F.xxhash64(F.lit(1), *marks)})
    narrow = land(keyed.select("source", F.col(key).alias("key"), F.col(tie).alias("tie"), word_count(F.col("text")).alias("size")), "mix_rows")
    plan = mixing.mix(narrow, "size", "source", "key").filter("copies > 0").select(F.col("key").alias(key), F.col("tie").alias(tie), F.col("copies").cast("int").alias(copies))
    texts = keyed.groupBy(key, tie).agg(F.first(F.struct(*docs.columns)).alias(row))
    taken = texts.join(plan.hint("merge"), [key, tie])  # both sides grow with the documents
    return taken.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(f"{row}.*")


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard (0 to 23) and slot (gapless from 0 in its shard); shard sizes come near equal.

    Ranges are measured on narrow columns; texts are shuffled once, with their range. Null texts have 8 bytes like
    empty ones; equal texts lie together unless their range is overfull; repeated rows get slots of their own. Columns
    named shard or slot are replaced. No rows in, none out.
    """
    text = F.coalesce("text", F.lit(""))
    size, key, tie = fresh(docs, "shard_size"), fresh(docs, "shard_key"), fresh(docs, "shard_tie")
    rows = docs.withColumns({size: (F.octet_length(text) + 8).cast("long"), key: F.xxhash64(text), tie: F.xxhash64(*_hashable(docs))})
    return sharding.shard(rows, size, key, tie, 24).drop(size, key, tie)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]

# SimHash, alignment and the learned model have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again as the next one's input."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
