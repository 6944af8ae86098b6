"""Reports over a corpus of behavioral records (one JSON document each), every report from one scan.

Scores and sections are marks that one aggregation sums. Names turn into tall facts (kind, name); their counts
and totals come from one aggregation over grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spoor.sources.scans import DOC, field

# fixed values: findings of the semantic passes
SEMANTIC_FINDINGS = ["STRAT-SD-001", "STRAT-HC-001", "STRAT-CE-001", "STRAT-SC-001", "STRAT-TV-001"]
HIGH_EXPOSURE, HIGH_AMPLIFICATION, LOW_AUDIT = 0.3, 20, 0.5


def read_records(lines: DataFrame) -> DataFrame:
    """(record_id, doc) of lines(record_id, raw) that are JSON objects."""
    return lines.select("record_id", F.try_parse_json("raw").alias(DOC)).filter(F.schema_of_variant(DOC).startswith("OBJECT"))


def _list(path: str) -> Column:
    return field(path, "array<variant>")


def _filled(path: str) -> Column:
    """A list or map with something in it."""
    return F.coalesce(F.size(field(path, "array<variant>")) > 0, F.size(field(path, "map<string,variant>")) > 0, F.lit(False))


def record_quality(records: DataFrame) -> DataFrame:
    """One row: records, records per filled section, records with a mode that showed, and the mean share of predicted paths that held.

    The mean runs over records that have traces; it is 0 without any.
    """
    truth = lambda v, key: F.coalesce(F.try_variant_get(v, f"$.{key}", "boolean"), F.lit(False))
    traces, modes = _list("error_propagation"), _list("failure_modes")
    hits = F.size(F.filter(traces, lambda v: truth(v, "structural_prediction_match")))
    d = records.select(
        *[_filled(s).alias(s) for s in ("edge_validation", "emergent_edges", "error_propagation", "monitoring_baselines")],
        F.coalesce(F.exists(modes, lambda v: truth(v, "manifestation_observed")), F.lit(False)).alias("manifested"), F.when(F.size(traces) > 0, hits / F.size(traces)).alias("match_rate"))
    sections = [F.count_if(s).alias(f"records_with_{s}") for s in ("edge_validation", "emergent_edges", "error_propagation", "monitoring_baselines")]
    return d.agg(F.count(F.lit(1)).alias("records"), *sections, F.count_if("manifested").alias("records_with_failure_modes_manifested"), F.coalesce(F.avg("match_rate"), F.lit(0.0)).alias("mean_match_rate"))


def finding_prevalence(records: DataFrame, findings: list[str] = SEMANTIC_FINDINGS) -> DataFrame:
    """(finding_id, count, rate) of each finding over all records; records list them under failure_modes, else findings."""
    listed = F.coalesce(_list("failure_modes"), _list("findings"), F.array().cast("array<variant>"))
    ids = F.transform(listed, lambda v: F.try_variant_get(v, "$.finding_id", "string"))
    marks = [F.coalesce(F.array_contains(ids, f), F.lit(False)).alias(f"f{i}") for i, f in enumerate(findings)]
    sums = records.select(*marks).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(f"f{i}").alias(f"f{i}") for i in range(len(findings))])
    rows = F.array(*[F.struct(F.lit(f).alias("finding_id"), F.col(f"f{i}").alias("count")) for i, f in enumerate(findings)])
    return sums.select("total", F.explode(rows).alias("r")).select("r.*", F.round(F.col("r.count") / F.greatest("total", F.lit(1)), 3).alias("rate"))


def _section(name: str, path: str, kind: str = "double") -> Column:
    """A value of an enrichment section; null where the section is missing or failed (holds 'error'), 0 where a number is missing."""
    at = f"research_enrichments.{name}"
    sound = F.schema_of_variant(field(at, "variant")).startswith("OBJECT") & field(f"{at}.error", "variant").isNull()
    value = field(f"{at}.{path}", kind)
    return F.when(sound, value if kind.startswith("array") else F.coalesce(value, F.lit(0).cast(kind)))


def _enriched(records: DataFrame) -> DataFrame:
    return records.filter(F.schema_of_variant(field("research_enrichments", "variant")).startswith("OBJECT") & F.coalesce(F.size(field("research_enrichments", "map<string,variant>")) > 0, F.lit(False)))


def enrichment_report(records: DataFrame) -> DataFrame:
    """One row: means of the enrichment scores and the records beyond their thresholds; failed sections do not count."""
    d = _enriched(records).select(
        _section("privacy_topology", "privacy_exposure_score").alias("exposure"), _section("permission_blast_radius", "permission_risk_score").alias("permission"), _section("permission_blast_radius", "mean_utilization_rate").alias("utilization"),
        _section("permission_blast_radius", "critical_asymmetries", "long").alias("asymmetries"), _section("cost_risk", "cost_risk_score").alias("cost"), _section("cost_risk", "token_amplification.max_amplification_ratio").alias("amplification"),
        _section("cost_risk", "retry_waste.corpus_retry_rate").alias("retries"), _section("audit_readiness", "audit_readiness_score").alias("audit"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 3)
    return d.agg(
        F.count(F.lit(1)).alias("enriched_records"), mean("exposure").alias("mean_exposure_score"), F.count_if(F.col("exposure") > HIGH_EXPOSURE).alias("repos_with_high_exposure"), mean("permission").alias("mean_permission_risk"),
        F.count_if(F.col("asymmetries") > 0).alias("repos_with_critical_asymmetries"), mean("utilization").alias("mean_utilization_rate"), mean("cost").alias("mean_cost_risk"), F.count_if(F.col("amplification") > HIGH_AMPLIFICATION).alias("repos_with_high_amplification"),
        mean("retries").alias("mean_retry_rate"), mean("audit").alias("mean_readiness_score"), F.count_if(F.col("audit") < LOW_AUDIT).alias("repos_below_threshold"))


def enrichment_names(records: DataFrame) -> DataFrame:
    """(kind, name, n, share, rank): domain flows and frameworks at risk with their counts, most frequent first, and of each kind the total (name null).

    All names, ranked; a report takes those up to its rank. Ties go to the smaller name.
    """
    words = lambda v, key: F.concat_ws(",", F.array_sort(F.coalesce(F.try_variant_get(v, f"$.{key}", "array<string>"), F.array().cast("array<string>"))))
    flows = F.transform(_section("privacy_topology", "cross_domain_flows", "array<variant>"), lambda v: F.struct(F.lit("flow").alias("kind"), F.concat(words(v, "source_domains"), F.lit("->"), words(v, "target_domains")).alias("name")))
    risks = F.transform(_section("audit_readiness", "frameworks_at_risk", "array<string>"), lambda v: F.struct(F.lit("framework").alias("kind"), v.alias("name")))
    none = F.array().cast("array<struct<kind:string,name:string>>")
    facts = _enriched(records).select(F.explode(F.concat(F.coalesce(flows, none), F.coalesce(risks, none))).alias("f")).select("f.kind", "f.name").filter("name IS NOT NULL")
    sums = facts.groupingSets([["kind", "name"], ["kind"]], "kind", "name").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    ranked = sums.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("level"), F.desc("n"), "name")) - 1)  # one row a name
    return ranked.withColumn("total", F.max("n").over(W.partitionBy("kind"))).select("kind", "name", "n", (F.col("n") / F.col("total")).alias("share"), "rank")


def remediation_report(evidence: DataFrame) -> DataFrame:
    """(finding_id, severity, corpus_prevalence, top_remediation, candidate_count) of evidence documents(doc); the ranked list's first is the top."""
    e = evidence.select(F.explode(_list("evidence")).alias("e"))
    at = lambda path, kind="string": F.try_variant_get("e", f"$.{path}", kind)
    size = F.coalesce(F.size(at("remediation_candidates", "array<variant>")), F.lit(0))
    return e.select(at("finding_id").alias("finding_id"), at("severity").alias("severity"), at("corpus_statistics.manifestation_rate", "double").alias("corpus_prevalence"), at("priority_ranked_remediations[0].name").alias("top_remediation"), F.when(size > 0, size).otherwise(0).alias("candidate_count"))
