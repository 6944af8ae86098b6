"""Readers of JSON-lines traces, graph documents and logs, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spoor.constants import REQUIRED_FIELDS
from spoor.functions.text import nz
from spoor.schema import EVENT, GRAPH, NODE_REF

# the flat layout has these at top level; source and target may be plain strings there
_FLAT = ["node_id", "timestamp", "status", "output_preview", "last_user_message_preview", "delegation_id", "tool_name",
         "source_node_id", "target_node_id", "state_key", "access_type", "accessor_node"]


# counters that some frameworks write under other names, in the payload or at top level
_TOKENS = {"input_tokens": ["prompt_tokens"], "output_tokens": ["completion_tokens"], "latency_ms": []}


def raw_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Non-blank lines of all files below a folder whose name fits `glob`, with file and run number."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.jsonl$", 1)
    return df.select(
        F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), name.alias("file_stem"),
        F.regexp_extract(F.col("_metadata.file_name"), r"events_run_(\d+)\.jsonl$", 1).try_cast("int").alias("run_number"),
    ).filter(F.col("line") != "")


def parse_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Parse lines in nested or flat layout into canonical events plus `valid` and `corrupt` flags.

    With a fixed schema a null required field counts as missing.
    """
    as_text = T.StructType([T.StructField(n, T.StringType()) for n in [*_FLAT, "source_node", "target_node", "payload"]])
    nested = F.from_json(F.col(line), EVENT)
    e = lines.withColumn("_e", nested).withColumn("_f", F.from_json(F.col(line), as_text))
    e = e.withColumn("corrupt", F.try_parse_json(F.col(line)).isNull() | ~F.startswith(F.col(line), F.lit("{")))
    flat = F.col("_f")
    iso = F.unix_micros(F.coalesce(*[F.try_to_timestamp(flat["timestamp"], F.lit(f)) for f in (
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")], F.try_to_timestamp(flat["timestamp"]))) * 1000

    def ref(side: str, own: str | None) -> F.Column:
        parsed = F.col(f"_e.{side}")
        text = flat[side]
        plain = F.when(~F.startswith(F.coalesce(text, F.lit("{")), F.lit("{")), text)
        rid = F.coalesce(nz(flat[f"{side}_id"]), plain, nz(flat[own]) if own else F.lit(None))
        return F.coalesce(
            F.when(F.startswith(F.coalesce(text, F.lit("")), F.lit("{")), parsed),
            F.when(rid.isNotNull(), F.struct(F.lit("").alias("node_type"), rid.alias("node_id"), F.lit("").alias("node_name"))).cast(NODE_REF))

    names = [n for own, others in _TOKENS.items() for n in (own, *others)]
    numbers = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    counters = F.from_json(F.col(line), T.StructType([*numbers.fields, T.StructField("payload", numbers)]))
    e = e.withColumn("_n", counters)

    def counter(own: str, dtype: T.DataType) -> F.Column:
        """The payload's own field unless it is 0, else its other names, else the same at top level, else the 0."""
        other = [F.col(f"_n.payload.{n}") for n in _TOKENS[own]] + [F.col(f"_n.{n}") for n in (own, *_TOKENS[own])]
        return F.coalesce(F.nullif(payload[own], F.lit(0)), *[F.nullif(c.cast(dtype), F.lit(0)) for c in other], payload[own])

    payload = F.col("_e.payload")
    fill = {n: flat[n] for n in _FLAT if n in EVENT["payload"].dataType.fieldNames()}
    fields = [(counter(f.name, f.dataType) if f.name in _TOKENS else F.coalesce(payload[f.name], fill[f.name].cast(f.dataType)) if f.name in fill else payload[f.name]).alias(f.name) for f in EVENT["payload"].dataType.fields]
    out = e.select(
        *[c for c in lines.columns], "corrupt",
        *[F.col(f"_e.{n}").alias(n) for n in ("event_id", "run_id", "repo_id", "framework", "event_type", "edge_type", "parent_event_id", "stack_depth")],
        F.coalesce("_e.timestamp_ns", iso).alias("timestamp_ns"), ref("source_node", "node_id").alias("source_node"), ref("target_node", None).alias("target_node"),
        F.struct(*fields).alias("payload"),
    )
    present = F.lit(True)
    for f in REQUIRED_FIELDS:
        present = present & F.col(f).isNotNull()
    return out.withColumn("valid", ~F.col("corrupt") & present)


def read_events(spark: SparkSession, path: str, glob: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(valid canonical events, quarantined lines)."""
    parsed = parse_events(raw_lines(spark, path, glob))
    return parsed.filter("valid").select(*EVENT.names, "file_stem", "run_number"), parsed.filter("NOT valid").select("file", "line", "corrupt")


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """Events per run file; a repository's raw_events/ folder wins over files beside it."""
    lines = raw_lines(spark, path).withColumn("repo_dir", F.regexp_extract("file", r"/([^/]+)/(?:raw_events/)?[^/]+$", 1))
    lines = lines.withColumn("raw", F.col("file").contains("/raw_events/"))
    has_raw = lines.filter("raw").select("repo_dir").distinct().withColumn("_has", F.lit(True))
    return parse_events(lines.join(has_raw, "repo_dir", "left").filter("raw OR _has IS NULL").drop("_has"))


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON graph documents; the file stem stands in for a missing repo_id."""
    g = spark.read.schema(GRAPH).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.json$", 1)
    g = g.select("*", F.coalesce(nz(F.col("repo_id")), stem).alias("_repo"))
    nodes = g.select(F.col("_repo").alias("repo_id"), "framework", F.posexplode(F.map_entries("nodes")).alias("node_ord", "n")).select(
        "repo_id", "framework", "node_ord", F.col("n.key").alias("node_id"), "n.value.*")
    edges = g.select(F.col("_repo").alias("repo_id"), F.posexplode(F.map_entries("edges")).alias("edge_ord", "e")).select(
        "repo_id", "edge_ord", F.col("e.key").alias("edge_id"), "e.value.*")
    return nodes, edges


def log_facts(lines: DataFrame) -> DataFrame:
    """Container log lines (repo_id, line_no, line) to facts: entry point, score, tier, pip failures."""
    tier = F.regexp_extract("line", r"(?i)tier\s*([12])", 1)
    return lines.groupBy("repo_id").agg(
        F.max_by(F.regexp_extract("line", r"(?i)entry point:?\s*(\S+)", 1), F.when(F.col("line").rlike(r"(?i)entry point:?\s*\S+"), F.col("line_no"))).alias("entry_point"),
        F.max_by(F.regexp_extract("line", r"score[=:]?\s*(\d+)", 1), F.when(F.col("line").rlike(r"score[=:]?\s*\d+"), F.col("line_no"))).alias("entry_score"),
        F.max(F.when(F.lower("line").contains("success"), nz(tier))).alias("tier_success"),
        F.count_if(F.lower("line").contains("pip install") & F.lower("line").contains("fail")).alias("pip_failures"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
