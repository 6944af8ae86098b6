"""Registered queries: text and source scans, semantic passes, remediation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.operators import contacts as K
from spoor.operators import outputs as U
from spoor.operators import remediation as M
from spoor.operators import semantic as L
from spoor.operators import source_scan as S
from spoor.plans.corpus import Corpus, Query, r6
from spoor.sources.inline import values
from spoor.sources.tables import with_ctes as W


def spread(c: Corpus, name: str):
    """A table whose rows cost far more to scan than to read: dealt out where its files give fewer tasks than cores."""
    t, cores = c.table(name), c.spark.sparkContext.defaultParallelism
    return t if t.rdd.getNumPartitions() >= cores else t.repartition(cores)


def files(c: Corpus, name: str = "pages", key: str = "page_id", text: str = "html"):
    """Pages, documents or conversation turns as source files of a repository."""
    t = spread(c, name)
    return t.select(F.lit(name).alias("repo_id"), F.concat(F.lit(f"{name}/"), F.col(key).cast("string"), F.lit(".py")).alias("path"), F.col(text).alias("content"))


def all_files(c: Corpus):
    return files(c).unionByName(files(c, "documents", "doc_id", "text")).unionByName(files(c, "benchmark", "item_id", "text"))


# Python-like files written by Spark from the rows of `part`: one file per row
_CODE = [
    "concat('class ', replace(p_brand, '#', ''), '(BaseModel):')", "'    size: int'", "concat('    ', replace(p_name, ' ', '_'), ': str')",
    "''", "concat('# ', p_type)", "'# a'", "'# b'", "'# c'", "'# d'", "'# e'", "'# f'", "'# g'", "'# h'", "'# i'",
    "CASE p_size % 2 WHEN 0 THEN 'from crewai import Agent' ELSE 'from langgraph.graph import StateGraph' END",
    "concat('lead = Agent(role=\"', p_name, '\", goal=\"sell {item}\")')", "'def work(text):'", "'    text = text.strip()'",
    "CASE WHEN p_size % 4 < 3 THEN '    try:' ELSE '    if text:' END", "concat('        crew.kickoff(timeout=', p_size * 10, ')')",
    "CASE p_size % 4 WHEN 0 THEN '    except Exception as e:' WHEN 1 THEN '    except (ValueError, KeyError):' WHEN 2 THEN '    except:' ELSE '    else:' END",
    "CASE WHEN p_size % 3 = 0 THEN '        logging.error(text)' ELSE '        return None' END", "concat('    state[\"', replace(p_name, ' ', '_'), '\"] = text')",
    "concat('    time.sleep(', p_size, ')')", "'    prompt = \"You are ONLY responsible for sales\"'", "concat('tools = [find_', replace(p_name, ' ', '_'), ', Other]')", "'@tool'", "concat('def tool_', p_size, '(x):')",
]


def _framework():
    """The framework of a row, by its id."""
    return F.get(F.array(*[F.lit(f) for f in ("crewai", "langgraph", "autogen", "custom")]), (F.col("doc_id") % 4).cast("int"))


def code_files(c: Corpus):
    text = F.concat_ws("\n", *[F.expr(t) for t in _CODE])
    return spread(c, "part").select(F.concat(F.lit("brand_"), "p_brand").alias("repo_id"), F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("content"))


_PT = "concat('brand_', p_brand) AS repo_id, concat('src/', CAST(p_partkey AS VARCHAR), '.py') AS path"
_CODE_ROWS = "cr AS (" + " UNION ALL ".join(
    f"SELECT {_PT}, {ln} AS line_number, '{cat}' AS category, {kind} AS kind, {near} AS near_boundary, p_size FROM part WHERE {cond}" for ln, cat, kind, near, cond in [
        (1, "output_validation", "'pydantic_model'", "false", "true"), (18, "input_sanitization", "'strip'", "true", "true"), (20, "timeout_iteration_guards", "'timeout'", "true", "true"),
        (21, "exception_handling_topology", "CASE p_size % 4 WHEN 0 THEN 'broad' WHEN 1 THEN 'specific' ELSE 'bare' END", "true", "p_size % 4 < 3"),
        (24, "rate_limiting_backoff", "'sleep'", "true", "true"), (25, "prompt_constraints", "'role_boundary'", "true", "true")]) + "), "


def s_has(x: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, w.replace("'", "''")) for w in words) + ")"


def s_cnt(x: str, words: list[str]) -> str:
    return "(" + " + ".join("CAST(contains({}, '{}') AS INT)".format(x, w.replace("'", "''")) for w in words) + ")"


_J1 = (
    "WITH t AS (SELECT conv_id, turn, text, lower(text) AS low, strlen(text) AS n FROM conversations), "
    "s AS (SELECT *, CASE WHEN ltrim(text) LIKE '{%' OR ltrim(text) LIKE '[%' THEN 3 ELSE 0 END AS st, "
    f"CAST(regexp_matches(text, '[0-9]{{2,}}') AS INT) + CAST(regexp_matches(text, '[A-Z][a-z]+\\s[A-Z]') AS INT) + CASE WHEN {s_cnt('low', [f' {v} ' for v in U.DEFINITE])} >= 2 THEN 2 ELSE 0 END AS fa, "
    f"{s_cnt('low', U.RECOMMEND)} AS rc, {s_cnt('low', U.SPECULATE)} AS sc, CASE WHEN {s_has('low', U.REFUSAL)} THEN 3 ELSE 0 END AS rf, CASE WHEN {s_has('low', U.DELEGATE)} THEN 3 ELSE 0 END AS dg FROM t), "
    "v AS (SELECT *, [fa, CASE WHEN rc >= 2 THEN 3 ELSE rc END, CASE WHEN sc >= 2 THEN 3 ELSE sc END, rf, st, CASE WHEN n > 200 AND st = 0 THEN 2 ELSE 0 END, dg, 0] AS a FROM s) "
    "SELECT conv_id, turn, CASE WHEN n < 20 THEN 'error_empty' ELSE ['factual', 'recommendation', 'speculative', 'refusal', 'structured', 'generative', 'delegative', 'error_empty'][list_position(a, list_max(a))] END AS primary, "
    "round(CASE WHEN n < 20 THEN 0.9::DOUBLE ELSE list_max(a) / greatest(list_sum(a), 1) END, 6) AS confidence FROM v"
)
_ERRC = (
    "SELECT doc_id, CASE WHEN {c1} THEN 'timeout' WHEN {k} AND {m} THEN 'schema_mismatch' WHEN {j} AND {d} THEN 'schema_mismatch' WHEN {t} AND {e} THEN 'schema_mismatch' WHEN {r} AND {l} THEN 'rate_limit' WHEN {a} THEN 'api_error' WHEN {p} THEN 'permission_error' ELSE 'runtime_error' END AS error_class FROM documents"
).format(**{k: s_has("lower(text)", v) for k, v in {"c1": ["timeout", "timed out"], "k": ["key"], "m": ["missing", "not found"], "j": ["json"], "d": ["decode", "parse"], "t": ["type"], "e": ["expected"], "r": ["rate"], "l": ["limit"], "a": ["api", "http", "connection"], "p": ["permission", "access"]}.items()})

# records: documents stand in for repositories, substring counts of their whole texts for pattern counts
_TOKENS = ["the", "ou", "MIT", "!", "@", "#", "ein", ".com", "%", "http", "key", "License", "\n\n", "http://", "*"]
_PATTERNS = M.CATEGORIES + M.SUB_FEATURES


def features(c: Corpus):
    n = lambda tok: (F.length("text") - F.length(F.replace("text", F.lit(tok), F.lit("")))) / len(tok)
    pairs = F.array(*[F.struct(F.lit(p).alias("pattern"), n(t).cast("long").alias("value")) for p, t in zip(_PATTERNS, _TOKENS)])
    return c.keep("pattern_features", lambda: c.table("documents").select(F.col("doc_id").alias("repo_id"), F.explode(pairs).alias("p")).select("repo_id", "p.*"))


def rem_findings(c: Corpus):
    d = c.table("documents").join(c.table("labels"), "doc_id", "left")
    rows = F.array_compact(F.array(
        F.when(F.col("quality").isNotNull(), F.struct(F.lit("STRAT-SI-001").alias("finding_id"), (F.col("quality") == 0).alias("manifested"))),
        F.when(F.col("lang") == "en", F.struct(F.lit("STRAT-DC-001").alias("finding_id"), (F.col("n_chars") % 2 == 0).alias("manifested"))),
        F.when(F.col("source").isin("src1", "src2", "src3", "src4", "src7"), F.struct(F.lit("STRAT-OC-002").alias("finding_id"), (F.col("n_chars") % 3 == 0).alias("manifested")))))
    return d.select(F.col("doc_id").alias("repo_id"), F.explode(rows).alias("r")).select("repo_id", "r.*")


_FE = "fe AS (" + " UNION ALL ".join(
    "SELECT doc_id AS repo_id, '{}' AS pattern, CAST((length(text) - length(replace(text, {}, ''))) / {} AS BIGINT) AS value FROM documents".format(p, "chr(10) || chr(10)" if t == "\n\n" else f"'{t}'", len(t)) for p, t in zip(_PATTERNS, _TOKENS)) + "), "
_RF = (
    "rf AS (SELECT doc_id AS repo_id, 'STRAT-SI-001' AS finding_id, quality = 0 AS m FROM documents JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'STRAT-DC-001', n_chars % 2 = 0 FROM documents WHERE lang = 'en' UNION ALL "
    "SELECT doc_id, 'STRAT-OC-002', n_chars % 3 = 0 FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src4', 'src7')), "
)
_DIFF = _FE + _RF + (
    "mo AS (SELECT finding_id, pattern, count(*) FILTER (m) AS n1, count(*) FILTER (NOT m) AS n2, count(*) FILTER (m AND value > 0) AS h1, count(*) FILTER (NOT m AND value > 0) AS h2, avg(value) FILTER (m) AS m1, avg(value) FILTER (NOT m) AS m2, var_samp(value) FILTER (m) AS v1, var_samp(value) FILTER (NOT m) AS v2 FROM rf JOIN fe USING (repo_id) GROUP BY ALL), "
    f"df AS (SELECT *, pattern IN ({', '.join(repr(x) for x in M.CATEGORIES)}) AS cat, CASE WHEN CAST(n1 AS DOUBLE) * n2 * (h1 + h2) * (n1 + n2 - h1 - h2) > 0 THEN (n1 + n2) * power(CAST(h1 AS DOUBLE) * (n2 - h2) - CAST(n1 - h1 AS DOUBLE) * h2, 2) / (CAST(n1 AS DOUBLE) * n2 * (h1 + h2) * (n1 + n2 - h1 - h2)) ELSE 0 END AS x, "
    "(m1 - m2) / CASE WHEN sqrt(v1 / n1 + v2 / n2) > 0 THEN sqrt(v1 / n1 + v2 / n2) ELSE 1e-10 END AS t FROM mo), "
    "dd AS (SELECT finding_id, pattern, n1, n2, h1 / n1 AS q1, h2 / n2 AS q2, m1, m2, cat, CASE WHEN cat THEN x ELSE t END AS statistic, CASE WHEN cat THEN exp(-x / 2) ELSE exp(-abs(t)) END AS p, CASE WHEN cat THEN h2 * (n1 - h1) / greatest(1, (n2 - h2) * h1) END AS od FROM df), "
)
_CO = (
    "pr AS (SELECT a.finding_id AS a, b.finding_id AS b, count(*) AS n FROM rf a JOIN rf b ON a.repo_id = b.repo_id AND a.finding_id <> b.finding_id GROUP BY ALL), tt AS (SELECT finding_id AS a, count(*) AS t FROM rf GROUP BY 1), "
    "co AS (SELECT a AS finding_id, b AS interacting_finding, n / t AS rate, n AS n_both, row_number() OVER (PARTITION BY a ORDER BY n / t DESC, b) AS rank FROM pr JOIN tt USING (a) WHERE n / t > 0.3), "
)


def judged(c: Corpus, number: int):
    """Judged answers as JSON text, one per conversation turn, written from the turn's own figures."""
    n, m = F.length("text"), F.col("turn")
    shapes = {
        1: F.struct((n % 2 == 0).alias("hedging_preserved"), (n % 3 == 0).alias("source_attribution_preserved"), (n % 5 > 0).alias("scope_preserved"), (n % 4 < 2).alias("factual_additions_detected"), (m % 2 == 0).alias("format_transformation_loss"),
                    (n % 7 > 0).alias("role_boundary_respected"), F.when(n % 3 == 0, "drift").when(n % 3 == 1, "loss").alias("mast_failure_mode")),
        2: F.struct((n % 2 == 0).alias("factual_agreement"), (n % 3 == 0).alias("structural_agreement"), F.when(n % 4 > 0, (n % 11) / 10).alias("semantic_overlap_estimate"), (n % 6).alias("novel_claims_in_other")),
        3: F.struct((n % 4 == 0).alias("information_accretion"), F.when(n % 5 > 0, (n % 10) / 10).alias("chain_fidelity"), F.when(n % 2 == 0, "hedged").otherwise("asserted").alias("confidence_at_origin"), F.when(n % 3 == 0, "asserted").alias("confidence_at_terminus")),
        4: F.struct(F.when(n % 3 == 0, "escalating").alias("confidence_trajectory"), (n % 5 == 0).alias("compensatory_assertion"), F.when(n % 4 == 0, "high").when(n % 4 == 1, "medium").alias("fabrication_risk")),
    }
    t = c.table("conversations").select(F.concat(F.lit("repo_"), "conv_id").alias("repo_id"), "turn", F.col("role").alias("source"), F.lit("judge").alias("target"), F.to_json(shapes[number]).alias("answer"))
    return L.answers(t, "answer", number)


_CV = "cv AS (SELECT concat('repo_', conv_id) AS repo_id, turn, role, length(text) AS n FROM conversations), "
_W_ON_EV = "w AS (SELECT *, CAST(event_id AS VARCHAR) AS eid FROM ev), "

QUERIES = [
    Query("j1_output_classes", lambda c: r6(U.classify_output(c.table("conversations"), "text").select("conv_id", "turn", "primary", "confidence")), _J1),
    Query("j2_output_signatures", lambda c: U.output_signature(c.table("conversations"), "text").select("conv_id", "turn", "hash", F.col("size_bytes").cast("long").alias("size_bytes"), "content_type"), (
        "SELECT conv_id, turn, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size_bytes, CASE WHEN length(text) > 500 THEN 'long_text' ELSE 'short_text' END AS content_type FROM conversations")),
    Query("j3_json_content_types", lambda c: U.output_signature(c.table("events").select("event_id", "props"), "props").select("event_id", "content_type", "structure")),
    Query("j6_error_classes", lambda c: c.table("documents").select("doc_id", U.error_class(F.col("text")).alias("error_class")), _ERRC),
    Query("j8_defensive_patterns", lambda c: S.scan_patterns(code_files(c)).select("repo_id", "path", "line_number", "category", "kind", "near_boundary"), "WITH " + _CODE_ROWS.rstrip(", ") + " SELECT repo_id, path, line_number, category, kind, near_boundary FROM cr"),
    Query("j8_sanitize_patterns", lambda c: S.scan_patterns(all_files(c)).filter("category IN ('concurrency_controls', 'rate_limiting_backoff')").select("path", "line_number", "category", "kind"), (
        "WITH f AS (SELECT 'pages/' || page_id || '.py' AS path, html AS x FROM pages UNION ALL SELECT 'documents/' || doc_id || '.py', text FROM documents UNION ALL SELECT 'benchmark/' || item_id || '.py', text FROM benchmark), "
        "l AS (SELECT path, unnest(string_split(replace(x, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(x, chr(13) || chr(10), chr(10)), chr(10)), 1) AS line_number FROM f), "
        "r AS (SELECT * FROM (VALUES " + ", ".join("('{}', '{}', '{}')".format(cat, k, rx) for cat, rules in (("concurrency_controls", S.CONCURRENCY), ("rate_limiting_backoff", S.RATE_LIMIT)) for k, rx in rules) + ") AS z(category, kind, rx)) "
        "SELECT path, CAST(line_number AS INTEGER) AS line_number, category, kind FROM l JOIN r ON regexp_matches(line, rx)")),
    Query("j9_delegation_lines", lambda c: S.delegation_lines(code_files(c)), f"SELECT {_PT}, 20 AS line_number, concat('crew.kickoff(timeout=', p_size * 10, ')') AS text FROM part"),
    Query("j15_pattern_summary", lambda c: S.pattern_summary(S.scan_patterns(code_files(c))), (
        "WITH " + _CODE_ROWS.rstrip(", ") + " SELECT repo_id, category, count(*) AS count, count(*) FILTER (near_boundary) AS near_boundary_count, count(*) FILTER (category = 'timeout_iteration_guards' AND p_size * 10 <= 120) AS effective_count, "
        "count(*) FILTER (category = 'exception_handling_topology' AND p_size % 3 = 0) AS has_logging_count, count(*) FILTER (kind = 'bare') AS bare_except_count, count(*) FILTER (kind = 'pydantic_model') AS pydantic_count, "
        "count(*) FILTER (kind = 'role_boundary') AS role_boundary_count, CAST(0 AS BIGINT) AS prohibition_count, CAST(0 AS BIGINT) AS uncertainty_instruction_count FROM cr GROUP BY ALL")),
    Query("j17_tool_registrations", lambda c: S.tool_registrations(code_files(c)), f"SELECT DISTINCT {_PT}, 'lead' AS scope, concat('find_', replace(p_name, ' ', '_')) AS tool FROM part UNION ALL SELECT {_PT}, 'lead', concat('tool_', p_size) FROM part"),
    Query("j19_state_keys", lambda c: S.state_keys(code_files(c)), "SELECT DISTINCT concat('brand_', p_brand) AS repo_id, key FROM (SELECT p_brand, 'size' AS key FROM part UNION ALL SELECT p_brand, replace(p_name, ' ', '_') FROM part)"),
    Query("j22_text_emails", lambda c: K.text_emails(c.table("documents"), "doc_id", "text"), (
        "SELECT DISTINCT doc_id, email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS email FROM documents) WHERE NOT regexp_matches(lower(email), '(noreply|no-reply|users\\.noreply\\.github\\.com)')")),
    Query("j27_email_domains", lambda c: K.text_emails(c.table("documents"), "doc_id", "text").groupBy(K.email_domain(F.col("email")).alias("domain"), K.is_personal(F.col("email")).alias("personal")).agg(F.count(F.lit(1)).alias("n")), (
        "WITH e AS (SELECT DISTINCT doc_id, email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS email FROM documents) WHERE NOT regexp_matches(lower(email), '(noreply|no-reply|users\\.noreply\\.github\\.com)')) "
        "SELECT lower(string_split(email, '@')[-1]) AS domain, lower(string_split(email, '@')[-1]) IN (" + ", ".join(f"'{d}'" for d in K.PERSONAL) + ") AS personal, count(*) AS n FROM e GROUP BY ALL")),
    Query("j30_best_contacts", lambda c: K.best_contact(K.merged_contacts(_people(c, "documents", "doc_id", "source", "developer"), _people(c, "documents", "doc_id", "lang", "maintainer"))), (
        "WITH e AS (SELECT DISTINCT doc_id, source, lang, email FROM (SELECT doc_id, source, lang, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS email FROM documents) WHERE NOT regexp_matches(lower(email), '(noreply|no-reply|users\\.noreply\\.github\\.com)')), "
        "a AS (SELECT source AS repo_id, lower(email) AS email, 'developer' AS role, 0 AS s FROM e UNION ALL SELECT lang, lower(email), 'maintainer', 1 FROM e), m AS (SELECT repo_id, email, arg_min(role, s) AS role FROM a GROUP BY ALL) "
        "SELECT repo_id, email, role FROM m QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY string_split(email, '@')[-1] IN (" + ", ".join(f"'{d}'" for d in K.PERSONAL) + "), CASE role WHEN 'maintainer' THEN 4 ELSE 5 END, email) = 1")),
    Query("j32_framework_hits", lambda c: S.framework_hits(code_files(c)), (
        "SELECT concat('brand_', p_brand) AS repo_id, 'crewai' AS framework, CAST(sum(2 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM part GROUP BY 1 UNION ALL SELECT concat('brand_', p_brand), 'langgraph', count(*) FROM part WHERE p_size % 2 = 1 GROUP BY 1")),
    Query("j34_agent_roles", lambda c: code_files(c).select("path", F.array_join(S.agent_roles(F.col("content")), ",").alias("roles")), "SELECT concat('src/', CAST(p_partkey AS VARCHAR), '.py') AS path, p_name AS roles FROM part"),
    Query("j35_variants", lambda c: spread(c, "documents").select("doc_id", S.variant(F.coalesce("text", F.lit("")), _framework()).alias("variant")), (
        "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN contains(t, 'allow_delegation') OR contains(lower(t), 'delegation') THEN 'delegation' WHEN contains(lower(t), 'tool') AND (contains(t, '@tool') OR contains(t, 'BaseTool')) THEN 'tooled' WHEN roles >= 3 THEN 'reviewed' ELSE 'delegation' END "
        "WHEN 1 THEN CASE WHEN contains(lower(t), 'conditional') THEN 'conditional' ELSE 'branching' END WHEN 2 THEN CASE WHEN contains(t, 'GroupChat') THEN 'groupchat' ELSE 'twoway' END ELSE 'delegation' END AS variant "
        "FROM (SELECT doc_id, coalesce(text, '') AS t, len(list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(?s)Agent\\s*\\([^)]*role\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), lambda r: trim(r))), lambda r: r <> '')) AS roles FROM documents)")),
    Query("j37_definitions", lambda c: S.definitions(code_files(c), "Agent", ["role", "goal", "backstory"], "role"), f"SELECT {_PT}, p_name AS role, 'sell example' AS goal, '' AS backstory FROM part"),
    # ---- semantic passes
    Query("l1_explicit_delegations", lambda c: L.explicit_delegations(c.events).select("run_id", "initiated_id", "completed_id"), W(
        "WITH " + _W_ON_EV + "d AS (SELECT run_id, eid, event_type, delegation_id, lag(eid) OVER q AS pe, lag(event_type) OVER q AS pt FROM w WHERE event_type LIKE 'delegation.%' WINDOW q AS (PARTITION BY run_id, delegation_id ORDER BY timestamp_ns, eid)) "
        "SELECT run_id, pe AS initiated_id, eid AS completed_id FROM d WHERE event_type = 'delegation.completed' AND pt = 'delegation.initiated'", "ev")),
    Query("l1_inferred_delegations", lambda c: L.inferred_delegations(c.events).select("run_id", "end_id", "source", "start_id", "target"), W(
        "WITH " + _W_ON_EV.rstrip(", ") + " SELECT e.run_id, e.eid AS end_id, e.source_id AS source, arg_min(s.eid, s.timestamp_ns) AS start_id, arg_min(s.source_id, s.timestamp_ns) AS target FROM w e JOIN w s ON s.run_id = e.run_id AND s.event_type = 'agent.task_start' AND s.timestamp_ns > e.timestamp_ns AND s.source_id <> e.source_id "
        "WHERE e.event_type = 'agent.task_end' GROUP BY e.run_id, e.eid, e.source_id", "ev")),
    Query("l6_delegation_pairs", lambda c: L.delegation_pairs(c.events).select("run_id", "kind", "source_event", "target_event", "source", "target", "output", "input", "pair_key", "first_of_pair"), W(
        "WITH " + _W_ON_EV + "d AS (SELECT run_id, eid, event_type, source_id, target_id, preview, timestamp_ns, lag(eid) OVER q AS pe, lag(event_type) OVER q AS pt, lag(source_id) OVER q AS ps, lag(preview) OVER q AS pp, lag(timestamp_ns) OVER q AS pn FROM w WHERE event_type LIKE 'delegation.%' WINDOW q AS (PARTITION BY run_id, delegation_id ORDER BY timestamp_ns, eid)), "
        "xp AS (SELECT run_id, 'explicit' AS kind, pe AS source_event, eid AS target_event, coalesce(ps, '') AS source, coalesce(target_id, '') AS target, coalesce(pp, '') AS output, pn AS ts FROM d WHERE event_type = 'delegation.completed' AND pt = 'delegation.initiated'), "
        "nf AS (SELECT e.run_id, 'inferred' AS kind, e.eid AS source_event, arg_min(s.eid, s.timestamp_ns) AS target_event, e.source_id AS source, arg_min(s.source_id, s.timestamp_ns) AS target, any_value(coalesce(e.preview, '')) AS output, any_value(e.timestamp_ns) AS ts FROM w e JOIN w s ON s.run_id = e.run_id AND s.event_type = 'agent.task_start' AND s.timestamp_ns > e.timestamp_ns AND s.source_id <> e.source_id WHERE e.event_type = 'agent.task_end' GROUP BY e.run_id, e.eid, e.source_id), "
        "al AS (SELECT * FROM xp UNION ALL SELECT * FROM nf ANTI JOIN xp USING (run_id, source, target)), "
        "pr AS (SELECT a.run_id, kind, source_event, target_event, source, target, any_value(output) AS output, arg_min(coalesce(user_message, ''), struct_pack(t := s.timestamp_ns, e := s.eid)) AS input FROM al a JOIN w s ON s.run_id = a.run_id AND s.event_type = 'llm.call_start' AND s.timestamp_ns > a.ts AND (a.target = '' OR s.source_id = a.target) WHERE length(output) >= 20 GROUP BY ALL) "
        "SELECT *, sha256(length(output) || ':' || output || input) AS pair_key, row_number() OVER (PARTITION BY output, input ORDER BY (SELECT any_value(repo_id) FROM w WHERE w.run_id = pr.run_id), run_id, target_event, source_event) = 1 AS first_of_pair FROM pr WHERE length(input) >= 20", "ev")),
    Query("l3_next_prompts", lambda c: L.next_prompts(c.events, c.events.filter("event_type = 'agent.task_end'").select("repo_id", "run_id", F.col("event_id").alias("ask_id"), F.col("source_node.node_id").alias("node"), "timestamp_ns")).select("run_id", "ask_id", "node", "call_id"), W(
        "WITH " + _W_ON_EV.rstrip(", ") + " SELECT e.run_id, e.eid AS ask_id, e.source_id AS node, arg_min(s.eid, s.timestamp_ns) AS call_id FROM w e LEFT JOIN w s ON s.run_id = e.run_id AND s.event_type = 'llm.call_start' AND s.timestamp_ns > e.timestamp_ns AND s.source_id = e.source_id WHERE e.event_type = 'agent.task_end' GROUP BY e.run_id, e.eid, e.source_id", "ev")),
    Query("l4_node_outputs", lambda c: L.node_outputs(c.events), W("SELECT repo_id, run_id, source_id AS node, arg_max(preview, timestamp_ns) AS preview FROM ev WHERE preview IS NOT NULL AND source_id <> '' GROUP BY ALL", "ev")),
    Query("l5_delegation_chain", lambda c: L.delegation_chain(c.events), W(
        "WITH f AS (SELECT repo_id, run_id, source_id AS node, arg_min(preview, timestamp_ns) AS pv, min(timestamp_ns) AS ts FROM ev WHERE event_type = 'agent.task_end' AND preview IS NOT NULL AND source_id <> '' GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts) - 1 AS position, count(*) OVER (PARTITION BY run_id) AS links FROM f) "
        "SELECT repo_id, run_id, position, links, node, pv AS output FROM g WHERE links >= 2", "ev")),
    Query("l8_chain_texts", lambda c: L.chain_text(L.delegation_chain(c.events)), W(
        "WITH f AS (SELECT repo_id, run_id, source_id AS node, arg_min(preview, timestamp_ns) AS pv, min(timestamp_ns) AS ts FROM ev WHERE event_type = 'agent.task_end' AND preview IS NOT NULL AND source_id <> '' GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY run_id) AS links FROM f), "
        "t AS (SELECT repo_id, run_id, string_agg('AGENT ' || CASE WHEN p = 0 THEN 'FIRST' WHEN p = links - 1 THEN 'LAST' ELSE 'MIDDLE (' || (p + 1) || '/' || links || ')' END || ' (' || string_split(node, ':')[-1] || ') output:' || chr(10) || pv, chr(10) || chr(10) ORDER BY p) AS text, max(links) AS links FROM g WHERE links >= 2 GROUP BY ALL) SELECT repo_id, run_id, text, links FROM t WHERE length(text) >= 50", "ev")),
    Query("l7_output_pairs", lambda c: L.output_pairs(c.events, from_rank=3), W(
        "WITH o AS (SELECT repo_id, run_id, source_id AS node, arg_max(preview, timestamp_ns) AS pv FROM ev WHERE preview IS NOT NULL AND source_id <> '' GROUP BY ALL), r AS (SELECT repo_id, run_id, row_number() OVER (PARTITION BY repo_id ORDER BY run_id) AS k FROM (SELECT DISTINCT repo_id, run_id FROM ev)) "
        "SELECT b.repo_id, b.node, b.run_id, b.pv AS other_output, a.pv AS first_output FROM o b JOIN r rb ON rb.run_id = b.run_id AND rb.k >= 3 JOIN r ra ON ra.repo_id = b.repo_id AND ra.k = 1 JOIN o a ON a.run_id = ra.run_id AND a.node = b.node WHERE length(a.pv) >= 20 AND length(b.pv) >= 20", "ev")),
    Query("l9_escalation_calls", lambda c: L.escalation_calls(c.events), W(
        "WITH w AS (SELECT *, CAST(event_id AS VARCHAR) AS eid FROM ev WHERE source_id <> ''), e AS (SELECT run_id, source_id, min(timestamp_ns) AS fe FROM w WHERE event_type LIKE 'error.%' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY run_id, source_id ORDER BY timestamp_ns, eid) - 1 AS position, count(*) OVER (PARTITION BY run_id, source_id) AS calls FROM w WHERE event_type = 'llm.call_end') "
        "SELECT repo_id, k.run_id, k.source_id AS node, position, calls, coalesce(fe < timestamp_ns, false) AS after_error, coalesce(preview, '') AS preview FROM k LEFT JOIN e ON e.run_id = k.run_id AND e.source_id = k.source_id WHERE calls >= 2 AND position < 5", "ev")),
    Query("l12_fidelity_scores", lambda c: r6(judged(c, 1).select("repo_id", "turn", L.fidelity_score().alias("fidelity"))), (
        "WITH " + _CV.rstrip(", ") + " SELECT repo_id, turn, round(greatest(0, least(1, (CAST(n % 2 = 0 AS INT) + CAST(n % 3 = 0 AS INT) + CAST(n % 5 > 0 AS INT) + CAST(n % 7 > 0 AS INT)) / 4 - (CAST(n % 4 < 2 AS INT) + CAST(turn % 2 = 0 AS INT)) * 0.15::DOUBLE)), 6) AS fidelity FROM cv")),
    Query("l13_stability_scores", lambda c: r6(judged(c, 2).select("repo_id", "turn", L.stability_score().alias("stability"), "confidence_direction", "novel_claims_in_other")), (
        "WITH " + _CV.rstrip(", ") + " SELECT repo_id, turn, round((CAST(n % 2 = 0 AS INT) + CAST(n % 3 = 0 AS INT) + CASE WHEN n % 4 > 0 THEN (n % 11) / 10 ELSE 0.5::DOUBLE END) / 3, 6) AS stability, 'unclear' AS confidence_direction, n % 6 AS novel_claims_in_other FROM cv")),
    Query("l11_aggregate_scores", lambda c: r6(L.aggregate_scores(judged(c, 1), judged(c, 3), judged(c, 4), ["repo_id"]).select("repo_id", "trust_elevation_rate", "mean_chain_fidelity", "elevation_rate", "fabrication_risk_rate", "oer_estimate")), (
        "WITH " + _CV + "a AS (SELECT repo_id, avg(CAST(n % 2 > 0 AND n % 4 < 2 AS INT)) AS te, avg(CASE WHEN n % 5 > 0 THEN (n % 10) / 10 ELSE 0.5::DOUBLE END) AS cf, avg(CAST(n % 2 = 0 AND n % 3 = 0 AS INT)) AS el, avg(CAST(n % 4 < 2 AS INT)) AS fr FROM cv GROUP BY 1) "
        "SELECT repo_id, round(te, 6) AS trust_elevation_rate, round(cf, 6) AS mean_chain_fidelity, round(el, 6) AS elevation_rate, round(fr, 6) AS fabrication_risk_rate, round(1 - (1 - te) * cf * (1 - fr), 6) AS oer_estimate FROM a")),
    Query("g27_edge_semantics", lambda c: r6(L.edge_semantics(judged(c, 1)).drop("dominant_mast_failure")), (
        "WITH " + _CV.rstrip(", ") + " SELECT repo_id, role AS source, 'judge' AS target, round(avg(CAST(n % 2 = 0 AS INT)), 6) AS hedging_preservation_rate, round(avg(CAST(n % 4 < 2 AS INT)), 6) AS factual_addition_rate, round(avg(CAST(n % 2 > 0 AND n % 4 < 2 AS INT)), 6) AS drift_rate, count(*) AS evaluation_count FROM cv GROUP BY ALL")),
    # ---- remediation
    Query("m2_quadrants", lambda c: M.quadrants(c.table("documents").select(F.col("doc_id").alias("repo_id")), rem_findings(c)), "WITH " + _RF.rstrip(", ") + " SELECT finding_id, count(*) FILTER (m) AS q1, count(*) FILTER (NOT m) AS q2, (SELECT count(*) FROM documents) - count(*) AS without_finding FROM rf GROUP BY 1"),
    Query("m5_m7_differential_closed_form", lambda c: r6(M.differential(rem_findings(c), features(c), exact=False)), (
        "WITH " + _DIFF.rstrip(", ") + " SELECT finding_id, pattern, n1, n2, round(q1, 6) AS q1_prevalence, round(q2, 6) AS q2_prevalence, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round(statistic, 6) AS statistic, round(p, 6) AS p_value, round(od, 6) AS odds_ratio FROM dd")),
    Query("m5_m6_m8_differential", lambda c: r6(M.differential(rem_findings(c), features(c)))),
    Query("m5_candidates_closed_form", lambda c: M.candidates(M.differential(rem_findings(c), features(c), exact=False)).select("finding_id", "pattern"), (
        "WITH " + _DIFF.rstrip(", ") + " SELECT finding_id, pattern FROM dd WHERE n1 >= 5 AND n2 >= 5 AND p < 0.1 AND CASE WHEN cat THEN q2 > q1 ELSE m2 > m1 END")),
    Query("m10_by_topology", lambda c: r6(M.by_topology(rem_findings(c), features(c), c.table("documents").select(F.col("doc_id").alias("repo_id"), M.topology_class(F.size(F.split("text", r"\.")), F.size(F.split("text", r"\.")) - 1, F.col("lang") != "en", F.length("source")).alias("topology"))).drop("chi2")), (
        "WITH " + _FE + _RF + "tp AS (SELECT doc_id AS repo_id, CASE WHEN k <= 2 THEN 'minimal' WHEN lang = 'en' THEN 'pipeline' WHEN length(source) > 2 THEN 'hub_and_spoke' ELSE 'branching' END AS topology FROM (SELECT *, length(text) - length(replace(text, '.', '')) + 1 AS k FROM documents)), "
        "g AS (SELECT finding_id, topology, pattern, count(*) FILTER (m) AS n1, count(*) FILTER (NOT m) AS n2, count(*) FILTER (m AND value > 0) AS h1, count(*) FILTER (NOT m AND value > 0) AS h2 FROM rf JOIN tp USING (repo_id) JOIN fe USING (repo_id) GROUP BY ALL) SELECT finding_id, topology, pattern, round(h2 / n2 - h1 / n1, 6) AS reduction, n1 + n2 AS n FROM g WHERE n1 >= 3 AND n2 >= 3")),
    Query("m11_co_occurring", lambda c: r6(M.co_occurring(rem_findings(c)).drop("rank")), "WITH " + _RF + _CO.rstrip(", ") + " SELECT finding_id, interacting_finding, round(rate, 6) AS rate, n_both FROM co WHERE rank <= 5"),
    Query("m12_m13_priorities", lambda c: r6(M.priorities(M.candidates(M.differential(rem_findings(c), features(c), exact=False)), values(c.spark, [("STRAT-SI-001", "high"), ("STRAT-DC-001", "critical"), ("STRAT-OC-002", "medium")], ["finding_id", "severity"]), M.co_occurring(rem_findings(c))).select("finding_id", "pattern", "priority")), (
        "WITH " + _DIFF + _CO + "k AS (SELECT finding_id, count(*) AS k FROM co WHERE rank <= 5 GROUP BY 1) SELECT finding_id, pattern, round(CASE WHEN cat THEN q2 - q1 ELSE least(0.8::DOUBLE, (coalesce(od, 1) - 1) / 10) END * CASE finding_id WHEN 'STRAT-DC-001' THEN 4 WHEN 'STRAT-SI-001' THEN 3 ELSE 2 END * (1 + 0.2::DOUBLE * coalesce(k, 0)) / "
        f"CASE WHEN pattern IN ({', '.join(repr(x) for x in M.LOW_EFFORT)}) THEN 1 ELSE 2 END, 6) AS priority FROM dd LEFT JOIN k USING (finding_id) WHERE n1 >= 5 AND n2 >= 5 AND p < 0.1 AND CASE WHEN cat THEN q2 > q1 ELSE m2 > m1 END")),
]


def _people(c: Corpus, name: str, key: str, repo: str, role: str):
    e = K.text_emails(c.table(name), key, "text")
    return e.join(c.table(name).select(key, F.col(repo).alias("repo_id")), key).select("repo_id", "email", F.lit(role).alias("role"))
