"""Exact dedup by sorting contents (DataFrame functions only).

Texts with every run of separators made one space are compared whole. A sample of rows gives splitters
over (first characters, digest, row hash); each row finds its range by binary search among them, so copies
of one text fill as many ranges as they need. One shuffle brings a range together, Spark's external sort
in the same order, then by whole text, places equal texts next to each other, and each text is compared
in full with its neighbour. Groups that
reach over range ends are joined by comparing the last text of a range with the first of the next; only
these few rows, at most two a range, are aggregated again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import buckets_for, fresh
from spoor.session import land

HEAD = 64
SAMPLE_PER_RANGE = 20
RANGE_BYTES = 256 << 20
POINT = "struct<head:string,digest:string,salt:bigint>"


def normalise(text: Column) -> Column:
    """The text (null: empty) with each run of \\x20 and \\x09-\\x0D replaced by one space."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    changed = F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")
    return F.when(text.rlike(r"[\x09-\x0D]|\x20{2}"), changed).otherwise(text)


def sort_point(text: Column, digest: Column, row: Column) -> Column:
    """Where a row lies among the splitters; equal texts lie together, and a row hash divides them."""
    return F.struct(F.substring(text, 1, HEAD).alias("head"), digest.alias("digest"), F.xxhash64(row).alias("salt"))


def splitters(rows: DataFrame, id_col: str, text: Column, row: str, ranges: int, per_range: int = SAMPLE_PER_RANGE) -> list[tuple]:
    """At most `ranges` - 1 ascending points that cut a sample of about `per_range` rows a range evenly.

    The driver holds the cuts alone, HEAD characters each; their number follows RANGE_BYTES.
    """
    total = rows.count()
    share = min(1.0, ranges * per_range / max(1, total))
    drawn = rows.filter(F.pmod(F.xxhash64(F.col(row), F.lit("draw")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    sample = land(drawn.select(text.alias("t"), F.col(row).alias("r")).select(sort_point(F.col("t"), F.sha2("t", 256), F.col("r")).alias("p")), "sort_sample")
    step = max(1, -(-sample.count() // ranges))
    # Spark's global sort numbers the sample range by range, so no task holds all of it.
    ordered = land(sample.orderBy("p").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sort_sample")
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    nth = F.col("before") + F.col("at")
    cuts = ordered.join(before, "part").filter((nth > 0) & (nth % step == 0)).select("p.*").distinct().collect()
    return sorted(tuple(c) for c in cuts)


def range_of(point: Column, cuts: list[tuple]) -> Column:
    """How many cuts are not above the point, by binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.struct(F.lit(h).alias("head"), F.lit(d).alias("digest"), F.lit(s).alias("salt")) for h, d, s in cuts])
    span = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.get(table, middle) > point
        inside = s["lo"] < s["hi"]
        return F.struct(F.when(inside & ~above, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(inside & above, middle).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), span, halve, lambda s: s["lo"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Null and empty texts are equal; a null id counts as larger than any other. Of equal texts the row with the
    smallest id stays, of rows with equal ids too exactly one, whichever is read first. keep_id is null only
    where the whole group has null ids. Other columns are ignored; an empty table gives an empty result.
    `docs` is read twice and numbered by position, so it must be a stored table or another repeatable plan.
    """
    rid = "row_no"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn(rid, F.monotonically_increasing_id())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(buckets_for(docs), -(-total // RANGE_BYTES))
    cuts = splitters(rows, "doc_id", normalise(F.col("text")), rid, ranges)
    body = rows.select("doc_id", rid, normalise(F.col("text")).alias("text")).withColumn("digest", F.sha2("text", 256))
    body = body.withColumn("range_no", range_of(sort_point(F.col("text"), F.col("digest"), F.col(rid)), cuts))

    order = Window.partitionBy("range_no").orderBy(F.substring("text", 1, HEAD), "digest", "text", F.col("doc_id").asc_nulls_last(), rid)
    last, after = F.lag("text").over(order), F.lead("text").over(order)
    body = body.withColumns({"last": last, "after": after})
    opens = F.col("last").isNull() | (F.col("last") != F.col("text"))
    body = body.select("range_no", "doc_id", rid, "digest", opens.cast("int").alias("opens"), F.when(F.col("last").isNull(), F.col("text")).alias("first_text"), F.when(F.col("after").isNull(), F.col("text")).alias("last_text"), F.sum(opens.cast("long")).over(order).alias("run"))
    within = Window.partitionBy("range_no", "run")
    stays = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"), F.col(rid).alias(rid))
    body = land(body.withColumns({"n": F.count("*").over(within), "stays": F.min(stays).over(within)}), "content_runs")

    totals = _across(body)
    whole = body.join(totals, ["range_no", "run"], "left")
    stay, size = F.coalesce("whole_stays", "stays"), F.coalesce("whole_n", "n")
    return whole.select("doc_id", stay["doc_id"].alias("keep_id"), size.alias("group_size"), (stay[rid] == F.col(rid)).alias("kept"), F.col("digest").alias("text_sha256"))


def _across(body: DataFrame) -> DataFrame:
    """(range_no, run, whole_n, whole_stays) for the runs that go on in a neighbouring range; at most two a range."""
    ends = body.filter("first_text is not null or last_text is not null").groupBy("range_no").agg(F.max("first_text").alias("first_text"), F.max("last_text").alias("last_text"), F.max("run").alias("runs"))
    line = Window.orderBy("range_no")
    place = ends.select("range_no").withColumn("place", F.row_number().over(line))  # one narrow row a range
    ends = land(ends.join(place, "range_no"), "range_ends")
    previous = ends.select((F.col("place") + 1).alias("place"), F.col("last_text").alias("previous"))
    joined = ends.join(previous, "place", "left").select("range_no", "runs", F.coalesce(F.col("previous") == F.col("first_text"), F.lit(False)).alias("goes_on"))
    through = F.col("goes_on") & (F.col("runs") == 1)
    start = F.last(F.when(~through, F.struct("range_no", "runs")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    joined = land(joined.withColumn("start", start), "range_chain")
    first = joined.filter("goes_on").select("range_no", F.lit(1).cast("long").alias("run"), "start")
    heads = first.select("start").distinct().select(F.col("start.range_no").alias("range_no"), F.col("start.runs").alias("run"), "start")
    links = first.unionByName(heads).distinct()
    parts = body.filter("opens = 1").join(links, ["range_no", "run"])
    sums = parts.groupBy("start").agg(F.sum("n").alias("whole_n"), F.min("stays").alias("whole_stays"))
    return links.join(sums, "start").select("range_no", "run", "whole_n", "whole_stays")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; nulls, ties and repeats as in `exact_groups`.

    Rows are numbered and stored first, then narrow rows decide and the numbers that stay select rows.
    """
    rid = fresh(docs, "row_key")
    rows = land(docs.withColumn(rid, F.monotonically_increasing_id()), "content_rows")
    order = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.col(rid).alias("row"))
    kept = exact_groups(rows.select(order.alias("o"), F.col(text_col).alias("t")), "o", "t").filter("kept").select(F.col("doc_id.row").alias(rid))
    return rows.join(kept, rid, "left_semi").select(*docs.columns)
