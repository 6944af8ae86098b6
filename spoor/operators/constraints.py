"""Declared constraints over tables: one pass per table, violations as tall rows.

Row rules of a table are evaluated together in one projection; rules that look at other rows (uniqueness,
references) are joins on their own columns, planned once. Counters of the same pass come from an
Observation, so nothing is read again to count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from spoor.session import land


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where `broken` is true; `detail` says why."""

    name: str
    broken: Column
    detail: Column


@dataclass(frozen=True)
class Unique:
    """Of rows with equal values in `columns`, all but the first by `order` break the rule; null values never do."""

    name: str
    columns: list[str]
    order: str


@dataclass(frozen=True)
class Reference:
    """Values of `columns` must occur in `other` (columns of the same names); null values are no reference."""

    name: str
    columns: list[str]
    other: DataFrame


@dataclass
class Constraints:
    table: str
    key: Column
    rows: list[Rule] = field(default_factory=list)
    unique: list[Unique] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)


def violations(df: DataFrame, c: Constraints, counters: dict[str, Column] | None = None) -> tuple[DataFrame, dict]:
    """((table, rule, key, detail) for every broken rule, counters of the row pass with its number of rows).

    A condition that is null counts as kept. Repeated rows report each. An empty table breaks nothing.
    """
    seen = Observation(f"{c.table} counters")
    cell = lambda r: F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), r.detail.cast("string").alias("detail")))
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[col.alias(n) for n, col in (counters or {}).items()])
    found = F.array_compact(F.array(*[cell(r) for r in c.rows])) if c.rows else F.array().cast("array<struct<rule:string,detail:string>>")
    out = observed.select(c.key.cast("string").alias("key"), found.alias("found"))
    out = land(out.select("key", F.explode("found").alias("f")).select(F.lit(c.table).alias("table"), "f.rule", "key", "f.detail"), "violations")
    for u in c.unique:
        rows = df.select(*u.columns, u.order, c.key.cast("string").alias("key")).dropna(subset=u.columns)
        first = rows.groupBy(*u.columns).agg(F.min(u.order).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
        again = rows.join(first, u.columns).filter(F.col(u.order) > F.col("_first"))
        out = out.unionByName(again.select(F.lit(c.table).alias("table"), F.lit(u.name).alias("rule"), "key", F.concat_ws(",", *u.columns).alias("detail")))
    for r in c.references:
        rows = df.select(*r.columns, c.key.cast("string").alias("key")).dropna(subset=r.columns)
        lost = rows.join(r.other.select(*r.columns).distinct(), r.columns, "left_anti")
        out = out.unionByName(lost.select(F.lit(c.table).alias("table"), F.lit(r.name).alias("rule"), "key", F.concat_ws(",", *r.columns).alias("detail")))
    return out, seen.get


def summary(*checked: tuple[str, DataFrame, int]) -> DataFrame:
    """(artifact, rule, broken) per rule, and (artifact, 'rows', n) so that an artifact without a violation shows too."""
    out = None
    for name, found, rows in checked:
        spark = found.sparkSession
        part = found.groupBy("rule").agg(F.count(F.lit(1)).alias("broken")).select(F.lit(name).alias("artifact"), "rule", "broken")
        part = part.unionByName(spark.range(1).select(F.lit(name).alias("artifact"), F.lit("rows").alias("rule"), F.lit(rows).cast("long").alias("broken")))
        out = part if out is None else out.unionByName(part)
    return out


# ---- exported traces (one JSON document a line) -----------------------------------------
# fixed values: keys that every exported document has
EXPORT_KEYS = ["repo_id", "repo_hash", "framework", "scan_status", "runs"]
URL = "https://github.com/"
_RUNS = "array<struct<agents:array<struct<agent_name:string,tasks:array<struct<output_text:string>>>>,delegation_chains:array<struct<upstream_agent:string,downstream_agent:string>>>>"


def export_violations(lines: DataFrame) -> tuple[DataFrame, dict]:
    """Audit of exported documents, lines(line, raw): every broken rule with its line, and the export's counters.

    Rules: valid JSON, an object, no key missing (one row each), repo_id a GitHub address, repo_id unique (later lines
    break it), runs present, some output not empty, and delegations only between agents seen up to their run. Lines
    without text are skipped.
    """
    raw = F.col("raw")
    d = lines.filter(F.trim(raw) != "").withColumn("doc", F.try_parse_json(raw))
    # JSON that is no object, or no JSON at all, has no keys
    d = d.withColumn("keys", F.when(F.col("doc").isNotNull(), F.json_object_keys(raw)))
    text = lambda k: F.try_variant_get("doc", f"$.{k}", "string")
    d = d.select("line", "raw", "doc", "keys", text("repo_id").alias("repo_id"), text("scan_status").alias("scan_status"), F.from_json(F.get_json_object(raw, "$.runs"), _RUNS).alias("runs"))
    d = land(d.withColumn("valid", F.col("doc").isNotNull()).withColumn("object", F.col("keys").isNotNull()).drop("doc", "raw"), "export_lines")
    ok = F.col("object")
    outputs = F.exists("runs", lambda r: F.exists(F.coalesce(r["agents"], F.array()), lambda a: F.exists(F.coalesce(a["tasks"], F.array()), lambda t: F.coalesce(t["output_text"] != "", F.lit(False)))))
    has_runs = F.coalesce(F.size("runs") > 0, F.lit(False))
    rules = [
        Rule("invalid_json", ~F.col("valid"), F.lit("")), Rule("not_an_object", F.col("valid") & ~ok, F.lit("")),
        *[Rule("missing_field", ok & ~F.array_contains("keys", k), F.lit(k)) for k in EXPORT_KEYS],
        Rule("not_a_github_url", ok & ~F.coalesce(F.col("repo_id").startswith(URL), F.lit(False)), F.coalesce("repo_id", F.lit(""))),
        Rule("no_runs", ok & ~has_runs, F.coalesce("repo_id", F.lit(""))), Rule("no_output", ok & has_runs & ~F.coalesce(outputs, F.lit(False)), F.coalesce("repo_id", F.lit(""))),
    ]
    counters = {"repos": F.count_if(ok), "success": F.count_if(ok & (F.col("scan_status") == "SUCCESS")), "partial": F.count_if(ok & (F.col("scan_status") == "PARTIAL_SUCCESS"))}
    found, seen = violations(d, Constraints("export", F.col("line"), rules, [Unique("duplicate_repo_id", ["repo_id"], "line")]), counters)

    runs = d.filter(has_runs).select("line", F.posexplode("runs").alias("run", "r"))
    agents = runs.select("line", "run", F.explode("r.agents.agent_name").alias("agent")).groupBy("line", "agent").agg(F.min("run").alias("since"))
    ends = F.array(*[F.struct(F.lit(f"unknown_{s}").alias("rule"), F.col(f"c.{s}_agent").alias("agent")) for s in ("upstream", "downstream")])
    chains = runs.select("line", "run", F.explode("r.delegation_chains").alias("c")).select("line", "run", F.explode(ends).alias("e")).select("line", "run", "e.rule", "e.agent").filter("agent <> ''")
    lost = chains.join(agents, ["line", "agent"], "left").filter("since IS NULL OR since > run")
    return found.unionByName(lost.select(F.lit("export").alias("table"), "rule", F.col("line").cast("string").alias("key"), F.col("agent").alias("detail"))), seen


# ---- behavioral records (JSON) ---------------------------------------------------------
# fixed values: sections of a record and counters of a trace's impact
RECORD_KEYS = ["repo_full_name", "schema_version", "execution_metadata", "edge_validation", "emergent_edges", "node_activation", "error_propagation", "failure_modes", "monitoring_baselines"]
IMPACT_KEYS = ["nodes_affected", "downstream_errors", "downstream_tasks_failed", "cascade_depth"]


def record_violations(records: DataFrame) -> DataFrame:
    """Broken rules of behavioral records(repo_id, raw): (table, rule, key, detail), detail being the field or place.

    Missing sections; and for each error trace that is an object: a source, two paths that are lists, a stop mechanism
    that is text, and an impact with its four counters.
    """
    raw = F.col("raw")
    d = records.withColumn("keys", F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")))
    top, _ = violations(d, Constraints("record", F.col("repo_id"), [Rule("missing_section", ~F.array_contains("keys", k), F.lit(k)) for k in RECORD_KEYS]))
    traces = d.withColumn("doc", F.try_parse_json(raw)).select("repo_id", F.posexplode(F.expr("CAST(try_variant_get(doc, '$.error_propagation', 'array<variant>') AS ARRAY<VARIANT>)")).alias("at", "t"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("t", path, "variant"))
    at = F.concat(F.lit("["), F.col("at").cast("string"), F.lit("]"))
    is_list = lambda p: F.coalesce(kind(p).startswith("ARRAY"), F.lit(False))
    impact = F.coalesce(kind("$.downstream_impact").startswith("OBJECT"), F.lit(False))
    has = lambda k: kind(f"$.downstream_impact.{k}").isNotNull()
    objects = traces.filter(F.schema_of_variant("t").startswith("OBJECT"))
    rules = [
        Rule("trace_without_source", kind("$.error_source_node").isNull(), at), Rule("predicted_path_no_list", ~is_list("$.structural_predicted_path"), at), Rule("observed_path_no_list", ~is_list("$.actual_observed_path"), at),
        Rule("stop_mechanism_no_text", ~F.coalesce(kind("$.stop_mechanism") == "STRING", F.lit(False)), at), Rule("impact_without_nodes", ~impact | ~has("nodes_affected"), at),
        *[Rule("impact_counter_missing", impact & has("nodes_affected") & ~has(k), F.concat(at, F.lit("." + k))) for k in IMPACT_KEYS],
    ]
    per, _ = violations(objects, Constraints("record", F.col("repo_id"), rules))
    return top.unionByName(per)


# ---- selection input -------------------------------------------------------------------
# fixed values: keys that every scanned repository brings to selection
SELECTION_KEYS = ["repo_full_name", "graph", "findings", "control_inventory", "framework", "agent_count", "edge_count"]


def selection_input_violations(documents: DataFrame) -> DataFrame:
    """One row per key that a scan document(scan_id, raw) lacks; text that is no object lacks all."""
    d = documents.withColumn("keys", F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")))
    return violations(d, Constraints("selection_input", F.col("scan_id"), [Rule("missing_field", ~F.array_contains("keys", k), F.lit(k)) for k in SELECTION_KEYS]))[0]


# ---- report artifacts ------------------------------------------------------------------
def artifact_summary(catalog: DataFrame, baselines: DataFrame, reports: DataFrame, min_reports: int = 100) -> DataFrame:
    """(artifact, rule, broken): prefixed finding ids, readable names, the schema version, and enough reports.

    catalog(finding_id, finding_name), baselines(finding_id, metric), reports(repo_id, schema_version).
    """
    strat = lambda: ~F.coalesce(F.col("finding_id").startswith("STRAT-"), F.lit(False))
    name = F.coalesce("finding_name", F.lit(""))
    a, n = violations(catalog, Constraints("catalog", F.col("finding_id"), [Rule("id_prefix", strat(), F.col("finding_id")), Rule("unreadable_name", name.startswith("STRAT-") | (F.length(name) <= 5), name)]))
    b, m = violations(baselines, Constraints("baselines", F.col("metric"), [Rule("id_prefix", strat(), F.col("finding_id"))], [Unique("duplicate_metric", ["repo_id", "metric"], "finding_id")]))
    r, k = violations(reports, Constraints("reports", F.col("repo_id"), [Rule("schema_version", ~F.coalesce(F.col("schema_version") == "v6", F.lit(False)), F.col("schema_version"))]))
    out = summary(("catalog", a, n["rows"]), ("baselines", b, m["rows"]), ("reports", r, k["rows"]))
    short = catalog.sparkSession.range(1).select(F.lit("reports").alias("artifact"), F.lit("too_few").alias("rule"), F.lit(int(k["rows"] < min_reports)).cast("long").alias("broken"))
    return out.unionByName(short)
