"""Run-status classification and the pilot quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spoor.functions.stats import count_if, ratio
from spoor.functions.text import contains_any

MIN_EVENTS = 10
# fixed values: text that marks a failure class in the error output
DEPENDENCY_TEXT = ["modulenotfounderror", "no module named", "importerror", "pkg_resources", "could not find a version", "pip install"]
ENTRY_TEXT = ["filenotfounderror", "no such file or directory", "syntaxerror", "indentationerror"]
MODEL_TEXT = ["openai", "api_key", "rate limit", "connection refused", "httpconnectionpool", "connection error"]
INSTRUMENTATION_TEXT = ["sitecustomize", "instrumentation"]  # add the names of your own instrumentation modules by parameter


def status(runs: DataFrame | None = None, instrumentation: list[str] = INSTRUMENTATION_TEXT) -> Column:
    """Status of a run row (status, exit_code, stderr, events, has_interaction), first rule wins."""
    text = F.lower(F.coalesce("stderr", F.lit("")))
    return (
        F.when(F.col("status") == "TIMEOUT", "TIMEOUT").when(contains_any(text, DEPENDENCY_TEXT), "DEPENDENCY_FAILURE").when(contains_any(text, ENTRY_TEXT), "ENTRY_POINT_FAILURE")
        .when(contains_any(text, MODEL_TEXT), "MODEL_FAILURE").when(contains_any(text, instrumentation), "INSTRUMENTATION_FAILURE")
        .when((F.col("exit_code") == 0) & (F.col("events") >= MIN_EVENTS) & F.col("has_interaction"), "SUCCESS").when((F.col("exit_code") == 0) | (F.col("events") > 0), "PARTIAL_SUCCESS").otherwise("CRASH"))


def classify(runs: DataFrame, instrumentation: list[str] = INSTRUMENTATION_TEXT) -> DataFrame:
    out = runs.withColumn("classified", status(runs, instrumentation))
    return out.withColumn("usable_for_dataset", F.col("classified").isin("SUCCESS", "PARTIAL_SUCCESS") & (F.col("events") >= 5))


def event_flags(events: DataFrame) -> DataFrame:
    """Per run: which families of events occurred (joined to the run table by classify_with_events)."""
    et = F.col("event_type")
    fam = {f"has_{f}_events": f + "." for f in ("agent", "llm", "delegation", "error")}
    return events.groupBy("repo_id", "run_id").agg(F.count(F.lit(1)).alias("events_emitted"), *[F.max(et.startswith(p)).alias(n) for n, p in fam.items()],
                                                   F.max(et.isin("llm.call_end", "agent.task_end") & F.col("payload.output_hash").isNotNull()).alias("has_semantic_data"))


def category(runs: DataFrame | None = None) -> Column:
    """Eight-way pilot category of a run row."""
    st, ev = F.coalesce("status", F.lit("")), F.col("events")
    rich = (ev >= MIN_EVENTS) & F.col("has_interaction")
    ended = F.when(rich, "SUCCESS").when(ev > 0, "PARTIAL_SUCCESS").otherwise("INSTRUMENTATION_FAILURE")
    partial_or = lambda other: F.when(ev > 0, "PARTIAL_SUCCESS").otherwise(other)
    return (
        F.when(st.isin("NO_ENTRY_POINT", "SERVER_BASED"), "ENTRY_POINT_FAILURE").when(st == "UNRESOLVABLE_IMPORT", "DEPENDENCY_FAILURE")
        .when((st == "TIMEOUT_NO_EVENTS") | F.coalesce(F.col("exit_code") == 124, F.lit(False)), partial_or("TIMEOUT"))
        .when((ev == 0) & contains_any(F.lower(F.coalesce("stderr", F.lit(""))), MODEL_TEXT), "MODEL_FAILURE")
        .when(st.isin("SUCCESS", "TIER2_SUCCESS", "PARTIAL_SUCCESS", "TIER2_PARTIAL"), ended).when(st == "NO_EVENTS", "INSTRUMENTATION_FAILURE")
        .when(st.isin("RUNTIME_ERROR", "MAX_RETRIES_EXCEEDED", "TIER2_FAILED"), partial_or("CRASH")).when(st == "CLONE_FAILED", "DEPENDENCY_FAILURE")
        .when(F.coalesce(F.col("exit_code") != 0, F.lit(False)), partial_or("CRASH")).when(ev == 0, "INSTRUMENTATION_FAILURE").when(rich, "SUCCESS").otherwise("PARTIAL_SUCCESS"))


def gate(categories: DataFrame, column: str = "category", *, instrumentation: float = 0.20, model: float = 0.15, passes_empty: bool = True) -> DataFrame:
    """One row: failure rates and whether both stay within their thresholds."""
    total = F.count(F.lit(1))
    a = categories.agg(total.alias("runs"), ratio(count_if(F.col(column) == "INSTRUMENTATION_FAILURE"), total).alias("instrumentation_rate"), ratio(count_if(F.col(column) == "MODEL_FAILURE"), total).alias("model_rate"))
    ok = (F.col("instrumentation_rate") <= instrumentation) & (F.col("model_rate") <= model)
    return a.withColumn("passed", F.when(F.col("runs") == 0, F.lit(passes_empty)).otherwise(ok))


def failures(classified: DataFrame) -> DataFrame:
    """Rows of the failures sheet: unsuccessful runs with the error message, 500 characters at most."""
    return classified.filter(~F.col("classified").isin("SUCCESS", "PARTIAL_SUCCESS")).select("repo_id", "run_id", F.col("classified").alias("status"), error_message(F.col("stderr")).alias("message"))


def error_message(stderr: Column, limit: int = 500) -> Column:
    """From the last traceback on, else the last five lines; the trailing characters are kept."""
    clean = F.trim(stderr)
    lines = F.split(clean, r"\r?\n")
    tb = F.regexp_extract(clean, r"(?s)^(?:.*\n)?(\s*Traceback.*)$", 1)
    tail = F.when(F.length(tb) > 0, F.regexp_replace(tb, r"^\s+", "")).otherwise(F.array_join(F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), F.lit(5)), "\n"))
    return F.when(F.coalesce(F.length(stderr), F.lit(0)) == 0, "Unknown error (no stderr)").otherwise(F.right(tail, F.lit(limit)))
