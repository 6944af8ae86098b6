"""Classification of agent outputs and error messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spoor.functions.text import contains_any

# fixed values: phrases that mark an output class
REFUSAL = ["i cannot", "i can't", "i don't have", "unable to", "i'm not able", "outside my"]
RECOMMEND = ["should", "recommend", "suggest", "consider", "advise"]
SPECULATE = ["might", "could", "possibly", "perhaps", "it seems", "likely", "may be", "unclear", "uncertain"]
DEFINITE = ["is", "was", "are", "were", "has", "had", "shows", "indicates"]
DELEGATE = ["i'll ask", "let me delegate", "passing to", "forwarding to"]
CLASSES = ["factual", "recommendation", "speculative", "refusal", "structured", "generative", "delegative", "error_empty"]
CLASS_KEYS = ["label", "class", "category", "classification", "type", "action", "decision", "next_step", "route", "intent", "sentiment", "priority", "severity", "status"]


def _hits(text: Column, words: list[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + text.contains(w).cast("int")
    return out


def classify_output(df: DataFrame, text: str, *, output_type: Column | None = None, size: Column | None = None) -> DataFrame:
    """Add primary class and confidence; the first class with the highest score wins."""
    t, kind = F.col(text), output_type if output_type is not None else F.lit("str")
    n = size if size is not None else F.octet_length(t)
    low = F.lower(t)
    graded = lambda k: F.when(k >= 2, 3).when(k == 1, 1).otherwise(0)
    structured = F.when(kind.isin("dict", "list") | F.ltrim(t).startswith("{") | F.ltrim(t).startswith("["), 3).otherwise(0)
    scores = F.array(
        t.rlike(r"\d{2,}").cast("int") + t.rlike(r"[A-Z][a-z]+\s[A-Z]").cast("int") + F.when(_hits(low, [f" {v} " for v in DEFINITE]) >= 2, 2).otherwise(0),
        graded(_hits(low, RECOMMEND)), graded(_hits(low, SPECULATE)), F.when(contains_any(low, REFUSAL), 3).otherwise(0), structured,
        F.when((n > 200) & (structured == 0), 2).otherwise(0), F.when(contains_any(low, DELEGATE), 3).otherwise(0), F.lit(0))
    d = df.withColumn("_n", n).withColumn("_s", scores)
    top = F.array_max("_s")
    total = F.aggregate("_s", F.lit(0), lambda a, x: a + x)
    short = F.col("_n") < 20
    d = d.withColumn("primary", F.when(short, "error_empty").otherwise(F.get(F.array(*[F.lit(c) for c in CLASSES]), F.array_position("_s", top).cast("int") - 1)))
    return d.withColumn("confidence", F.when(short, 0.9).otherwise(top / F.greatest(total, F.lit(1)))).drop("_n", "_s")


def output_signature(df: DataFrame, text: str) -> DataFrame:
    """Hash, size, content type, key structure and classification fields of an output text."""
    t = F.col(text)
    obj = F.try_parse_json(F.when(F.ltrim(t).startswith("{"), t))
    d = df.withColumn("_v", obj).withColumn("_m", F.from_json(F.when(F.col("_v").isNotNull(), t), "map<string,string>"))
    keys = F.transform(F.map_keys("_m"), lambda k: F.lower(k))
    has = lambda *k: F.arrays_overlap(keys, F.array(*[F.lit(x) for x in k]))
    kind = (F.when(F.col("_m").isNull(), F.when(F.length(t) > 500, "long_text").otherwise("short_text")).when(has("label", "class", "category", "classification", "type", "intent"), "classification")
            .when(has("action", "decision", "next_step", "route"), "routing_decision").when(has("score", "rating", "confidence", "probability"), "scored_output").otherwise("structured_json"))
    fields = F.transform_values(F.map_filter("_m", lambda k, v: F.lower(k).isin(CLASS_KEYS)), lambda k, v: v)
    return d.withColumn("hash", F.sha2(t, 256)).withColumn("size_bytes", F.octet_length(t)).withColumn("content_type", kind).withColumn(
        "structure", F.when(F.col("_v").isNotNull(), F.schema_of_variant("_v"))).withColumn("classification_fields", F.when(F.size(fields) > 0, fields)).drop("_v", "_m")


def error_class(message: Column, error_type: Column | None = None) -> Column:
    """Behavioral class of an error message, first rule wins; the exception class decides last."""
    m = F.lower(message)
    c = lambda *w: contains_any(m, list(w))
    out = (
        F.when(c("timeout", "timed out"), "timeout").when(c("key") & c("missing", "not found"), "schema_mismatch").when(c("json") & c("decode", "parse"), "schema_mismatch")
        .when(c("type") & c("expected"), "schema_mismatch").when(c("rate") & c("limit"), "rate_limit").when(c("api", "http", "connection"), "api_error").when(c("permission", "access"), "permission_error"))
    if error_type is not None:
        out = out.when(error_type.isin("KeyError", "TypeError", "ValueError", "AttributeError"), "schema_mismatch").when(error_type.isin("TimeoutError", "asyncio.TimeoutError"), "timeout")
    return out.otherwise("runtime_error")
