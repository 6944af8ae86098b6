"""Canonical events and graphs derived from the shared test tables.

The tables are not agent traces, so each row is read as one trace event: the row's type and its
`props.k` value choose the event type, node and payload. The mapping is plain arithmetic over
columns; every row of the table becomes exactly one event. `EVENT_LAYERS` and `EDGE_LAYERS` are
SQL expression text that Spark and the checking SQL engine both accept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spoor.functions.ordered import scan
from spoor.schema import EVENT, NODE_REF, PAYLOAD
from spoor.sources.inline import values

# node index -> (id, type, display name, class, file, line)
NODES = [
    ("agent_planner", "agent", "Planner", "Planner", "agents.py", 10),
    ("agent_research_lead", "agent", "Research Lead", "ResearchLead", "agents.py", 20),
    ("agent_writer_crew", "agent", "Content Writer", "Writer", "agents.py", 30),
    ("agent_reviewer", "agent", "Reviewer", "Reviewer", "review.py", 40),
    ("agent_intake_router", "agent", "Intake Router", "Router", "router.py", 50),
    ("cap_SearchTool_tool", "capability", "SearchTool", "SearchTool", "tools.py", 60),
    ("ds_vector_store", "data_store", "Vector Store", "VectorStore", "store.py", 70),
    ("ext_web_api", "external", "Web API", "WebClient", "web.py", 80),
    ("guard_input_12", "guardrail", "Input Guard", "InputGuard", "guards.py", 90),
]

# (row type, variant 0..4) -> event type
EVENT_TYPES = {
    "view": ["llm.call_start", "llm.call_end", "data.read", "message.received", "routing.decision"],
    "click": ["tool.invoked", "delegation.initiated", "external.call", "tool.invoked", "delegation.initiated"],
    "purchase": ["tool.completed", "delegation.completed", "data.write", "state.access", "tool.completed"],
    "signup": ["agent.task_start", "agent.task_end", "execution.start", "decision.made", "agent.task_end"],
    "error": ["error.occurred", "error.propagated", "tool.call_failure", "guardrail.triggered", "error.cascade"],
}


def pick(index: str, values: list[str | None]) -> str:
    """CASE text that maps a small integer to one of the values."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {index} {arms} END"


def _event_type() -> str:
    arms = " ".join(
        f"WHEN et = '{et}' AND v = {v} THEN '{name}'"
        for et, names in EVENT_TYPES.items() for v, name in enumerate(names)
    )
    return f"CASE {arms} END"


def _ref(index: str, form: str) -> tuple[str, str, str]:
    """A node reference in one of four shapes: direct id, runtime id, name only, unknown id."""
    runtime = [f"crewai:{cls}:src/{file}:{line}" for _, _, _, cls, file, line in NODES]
    rid = (
        f"CASE {form} WHEN 0 THEN {pick(index, [n[0] for n in NODES])} "
        f"WHEN 1 THEN {pick(index, runtime)} WHEN 2 THEN '' ELSE concat('tmp_', {index} % 3) END"
    )
    name = f"CASE WHEN {form} IN (0, 2) THEN {pick(index, [n[2] for n in NODES])} ELSE '' END"
    return rid, name, pick(index, [n[1] for n in NODES])


_SRC_ID, _SRC_NAME, _SRC_TYPE = _ref("n", "(q % 4)")
_TGT_ID, _TGT_NAME, _TGT_TYPE = _ref("t", "(p % 4)")
_IDS = [n[0] for n in NODES]
_HAS_TARGET = (
    "event_type IN ('tool.invoked', 'tool.completed', 'tool.call_failure', 'data.read', 'data.write', "
    "'delegation.initiated', 'delegation.completed', 'external.call', 'llm.call_start', 'message.received')"
)
_IS_ERROR = "event_type IN ('error.occurred', 'error.propagated', 'error.cascade', 'tool.call_failure')"
_TOOLS = ["web_search", "sql_query", "send_email", "run_python", "SearchTool", "file_writer", "config_admin"]
_KEYS = ["user_profile", "payment_token", "calendar_slot", "draft"]

# Each layer is a list of (column, expression) over the columns of the layer before.
# Layer 0 input: event_id, user_id, et, value, k, us (epoch microseconds).
EVENT_LAYERS: list[list[tuple[str, str]]] = [
    [
        ("n", "k % 9"),
        ("v", "CAST(floor(k / 9) AS BIGINT) % 5"),
        ("c", "CAST(round(value * 100) AS BIGINT)"),
        ("run_no", "CAST(floor((us - 1704067200000000) / 864000000000) AS BIGINT)"),
    ],
    [
        ("event_type", _event_type()),
        ("t", "(n + 1 + c % 8) % 9"),
        ("q", "CAST(floor(c / 8) AS BIGINT) % 4"),
        ("p", "CAST(floor(c / 32) AS BIGINT) % 4"),
        ("repo_id", "concat('repo_', user_id)"),
        ("run_id", "concat('run_', user_id, '_', run_no)"),
        ("timestamp_ns", "us * 1000"),
    ],
    [
        ("source_id", _SRC_ID), ("source_name", _SRC_NAME), ("source_type", _SRC_TYPE),
        ("target_id", f"CASE WHEN {_HAS_TARGET} THEN {_TGT_ID} END"),
        ("target_name", f"CASE WHEN {_HAS_TARGET} THEN {_TGT_NAME} END"),
        ("target_type", f"CASE WHEN {_HAS_TARGET} THEN {_TGT_TYPE} END"),
        ("src_struct", pick("n", _IDS)), ("tgt_struct", pick("t", _IDS)),
        ("tool_name", f"CASE WHEN event_type LIKE 'tool.%' THEN {pick('(c % 7)', _TOOLS)} END"),
        ("status", "CASE WHEN event_type IN ('tool.completed', 'agent.task_end') THEN CASE WHEN c % 5 = 0 THEN 'error' WHEN c % 5 = 1 THEN 'failure' ELSE 'success' END END"),
        ("input_tokens", "CASE WHEN event_type = 'llm.call_end' THEN k * 10 END"),
        ("output_tokens", "CASE WHEN event_type = 'llm.call_end' THEN c % 500 END"),
        ("error_type", f"CASE WHEN {_IS_ERROR} THEN {pick('(c % 4)', ['timeout', 'schema_mismatch', 'rate_limit', None])} END"),
        ("error_handling", f"CASE WHEN {_IS_ERROR} THEN {pick('(c % 6)', ['caught_silent', 'caught_default', 'retry', 'fail_silent', 'fail_fast', None])} END"),
        ("default_value_used", f"CASE WHEN {_IS_ERROR} THEN c % 6 = 1 END"),
        ("latency_ms", "CASE WHEN event_type NOT IN ('state.access', 'message.received') THEN value END"),
        ("option_hash", "CASE WHEN event_type = 'decision.made' THEN concat('opt_', c % 3) END"),
        ("input_hash", "CASE WHEN event_type IN ('decision.made', 'execution.start') THEN concat('in_', c % 2) END"),
        ("confidence", "CASE WHEN event_type = 'decision.made' THEN CAST(k AS DOUBLE) / 100 END"),
        ("is_retry", "event_type = 'tool.invoked' AND c % 10 = 0"),
        ("prevented", "CASE WHEN event_type = 'guardrail.triggered' THEN c % 2 = 0 END"),
        ("bypassed", "CASE WHEN event_type = 'guardrail.triggered' THEN c % 7 = 0 END"),
        ("retry_triggered", "CASE WHEN event_type = 'guardrail.triggered' THEN c % 3 = 0 END"),
        ("false_positive", "CASE WHEN event_type = 'guardrail.triggered' THEN c % 11 = 0 END"),
        ("data_size", "CASE WHEN event_type IN ('data.read', 'data.write', 'delegation.initiated') THEN c % 4096 END"),
        ("schema_mismatch", "event_type = 'data.write' AND c % 9 = 0"),
        ("data", "CASE WHEN event_type IN ('data.read', 'data.write') AND c % 3 > 0 THEN 'rows' END"),
        ("condition_result", "CASE WHEN event_type = 'delegation.initiated' THEN c % 3 = 0 END"),
        ("downstream_impact", f"CASE WHEN {_IS_ERROR} THEN c % 13 = 0 END"),
        ("agent_ref", f"CASE WHEN event_type IN ('tool.invoked', 'tool.completed', 'tool.call_failure') AND c % 2 = 0 THEN {pick('(c % 5)', [n[2] for n in NODES[:5]])} END"),
        ("state_key", f"CASE WHEN event_type IN ('state.access', 'data.write') THEN {pick('(c % 4)', _KEYS)} END"),
        ("access_type", f"CASE WHEN event_type = 'state.access' THEN {pick('(c % 3)', ['write', 'read', 'read_write'])} END"),
        ("output_hash", "CASE WHEN event_type IN ('llm.call_end', 'agent.task_end') THEN concat('h', c % 6) END"),
        ("context_hash", "CASE WHEN event_type = 'delegation.initiated' THEN concat('h', c % 6) END"),
        ("context_source", f"CASE WHEN event_type = 'delegation.initiated' AND c % 4 = 0 THEN {pick('n', _IDS)} END"),
        ("classified", "CASE WHEN event_type = 'agent.task_end' AND c % 8 = 0 THEN 'category' END"),
        ("class_dependency", "CASE WHEN event_type = 'delegation.initiated' THEN c % 7 = 0 END"),
        ("delegation_type", "CASE WHEN event_type = 'delegation.initiated' AND c % 2 = 0 THEN 'framework_internal' END"),
        ("delegation_id", "CASE WHEN event_type LIKE 'delegation.%' THEN concat('d', k % 12) END"),
        ("edge_type", "CASE WHEN event_type LIKE 'delegation.%' AND c % 3 = 0 THEN 'delegates_to' END"),
        ("trigger", "CASE WHEN event_type LIKE 'delegation.%' AND c % 4 = 1 THEN concat('cond_', c % 3) END"),
        ("routing_source", f"CASE WHEN event_type = 'routing.decision' THEN {pick('n', _IDS)} END"),
        ("routing_target", f"CASE WHEN event_type = 'routing.decision' THEN {pick('t', _IDS)} END"),
        ("decision_basis", "CASE WHEN event_type = 'routing.decision' THEN CASE WHEN c % 2 = 0 THEN 'llm_output' ELSE 'static' END END"),
        ("stack_depth", "c % 6"),
        ("preview", "CASE WHEN event_type IN ('agent.task_end', 'llm.call_end') AND c % 3 > 0 THEN concat('output number ', c % 100, ' of a node with findings') END"),
        ("user_message", "CASE WHEN event_type = 'llm.call_start' AND c % 4 > 0 THEN CASE WHEN c % 4 = 1 THEN 'short' ELSE concat('please work on item ', c % 50, ' with the earlier output') END END"),
        ("origin_node", f"CASE WHEN event_type = 'error.cascade' THEN {pick('n', _IDS)} END"),
        ("terminal_node", f"CASE WHEN event_type = 'error.cascade' THEN {pick('t', _IDS)} END"),
        ("is_propagation", "event_type = 'error.propagated'"),
        ("parent_node", f"CASE WHEN event_type = 'agent.task_start' AND c % 2 = 0 THEN {pick('t', _IDS)} END"),
        ("input_source", f"CASE WHEN event_type = 'agent.task_start' AND c % 3 = 0 THEN {pick('((t + 1) % 9)', _IDS)} END"),
        ("tool_node", f"CASE WHEN event_type = 'tool.invoked' THEN {pick('(c % 3)', ['cap_SearchTool_tool', 'ext_web_api', None])} END"),
        ("accessor", f"CASE WHEN event_type = 'state.access' THEN {pick('n', _IDS)} END"),
        ("stack_top", f"CASE WHEN event_type = 'llm.call_end' AND c % 3 > 0 THEN {pick('t', _IDS)} END"),
    ],
]

# payload field -> flat column of the last layer
_PAYLOAD_FROM = {
    "tool_name": "tool_name", "status": "status", "input_tokens": "input_tokens",
    "output_tokens": "output_tokens", "error_type": "error_type", "latency_ms": "latency_ms",
    "error_handling": "error_handling", "default_value_used": "default_value_used",
    "selected_option_hash": "option_hash", "input_hash": "input_hash", "confidence": "confidence",
    "is_retry": "is_retry", "action_prevented": "prevented", "bypassed": "bypassed",
    "retry_triggered": "retry_triggered", "false_positive": "false_positive",
    "data_size_bytes": "data_size", "schema_mismatch": "schema_mismatch", "data": "data",
    "condition_result": "condition_result", "downstream_impact": "downstream_impact",
    "agent_id": "agent_ref", "state_key": "state_key", "access_type": "access_type",
    "output_hash": "output_hash", "context_hash": "context_hash",
    "context_source_node": "context_source", "classification_fields": "classified",
    "has_classification_dependency": "class_dependency", "delegation_type": "delegation_type",
    "delegation_id": "delegation_id", "trigger": "trigger", "source_node": "routing_source",
    "target_node": "routing_target", "selected_target": "routing_target",
    "decision_basis": "decision_basis", "output_preview": "preview", "last_user_message_preview": "user_message",
    "origin_node": "origin_node", "terminal_node": "terminal_node",
    "parent_node_id": "parent_node", "input_source": "input_source", "tool_node_id": "tool_node",
    "accessor_node": "accessor",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide flat row per event; unused columns are pruned by Catalyst."""
    df = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("event_type").alias("et"), "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz")).alias("us"),
    )
    for layer in EVENT_LAYERS:
        df = df.select("*", *[F.expr(text).alias(name) for name, text in layer])
    return df


def _payload(name: str, dtype) -> Column:
    if name == "node_id":
        return F.when(F.col("event_type") == "state.access", F.col("src_struct")).alias(name)
    if name == "propagation_path":
        path = F.array("src_struct", "tgt_struct", F.expr(pick("((t + 2) % 9)", _IDS)))
        return F.when(F.col("is_propagation"), path).alias(name)
    if name == "active_node_stack":
        return F.when(F.col("stack_top").isNotNull(), F.array("src_struct", "stack_top")).alias(name)
    src = _PAYLOAD_FROM.get(name)
    return (F.col(src) if src else F.lit(None)).cast(dtype).alias(name)


def events(spark: SparkSession, sf_dir: str, linked: bool = False) -> DataFrame:
    """Canonical events. `linked` also fills `parent_event_id` with the event before in the run."""
    df = flat_events(spark, sf_dir)
    if linked:
        df = scan(df, ["repo_id", "run_id"], "timestamp_ns", {"parent_event_id": ("nearest", F.col("event_id"))}, tie=["event_id"])
    else:
        df = df.withColumn("parent_event_id", F.lit(None))
    ref = lambda side: F.struct(*[F.col(f"{side}_{part}").alias(f"node_{part}") for part in ("type", "id", "name")])
    return df.select(
        F.col("event_id").cast("string").alias("event_id"), "timestamp_ns", "run_id", "repo_id",
        F.lit("crewai").alias("framework"), "event_type",
        ref("source").cast(NODE_REF).alias("source_node"),
        F.when(F.col("target_type").isNotNull(), ref("target").cast(NODE_REF)).alias("target_node"),
        "edge_type", F.struct(*[_payload(f.name, f.dataType) for f in PAYLOAD.fields]).alias("payload"),
        F.col("parent_event_id").cast("string").alias("parent_event_id"), F.col("stack_depth").cast("long").alias("stack_depth"),
    ).select(*EVENT.names)


# ---- graphs ---------------------------------------------------------------
# Over every (s, t) pair of node indexes of a user; `st`, `tt` are node types.
EDGE_RULE = "s <> t AND (3 * s + t + user_id) % 4 = 0"
EDGE_TYPE = (
    "CASE WHEN tt = 'guardrail' THEN CASE WHEN (s + user_id) % 2 = 0 THEN 'guarded_by' ELSE 'filtered_by' END "
    "WHEN st = 'agent' AND tt = 'agent' THEN CASE WHEN (s + t + user_id) % 5 = 0 THEN 'feeds_into' ELSE 'delegates_to' END "
    "WHEN st = 'agent' AND tt = 'capability' THEN 'uses' "
    "WHEN tt = 'data_store' THEN CASE WHEN (s + user_id) % 3 = 0 THEN 'reads_from' ELSE 'writes_to' END "
    "WHEN tt = 'external' THEN 'calls' "
    "WHEN st = 'data_store' AND (s + t + user_id) % 7 = 0 THEN 'arbitrated_by' "
    "WHEN st = 'data_store' THEN 'shares_with' ELSE 'feeds_into' END"
)
FRAMEWORK = "CASE user_id % 3 WHEN 0 THEN 'crewai' WHEN 1 THEN 'langgraph' ELSE 'autogen' END"
PRECONDITION_RULE = "(user_id * (i + 3) + i) % 13 < 5"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct()


def _node_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *n) for i, n in enumerate(NODES)]
    return values(spark, rows, ["node_ord", "node_id", "node_type", "name", "class_name", "source_file", "line_number"])


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes(repo_id, framework, node_ord, node_id, node_type, name, class_name, source_file, line_number, strategy)."""
    strategy = "CASE (node_ord + user_id) % 4 WHEN 0 THEN 'retry' WHEN 1 THEN 'fail_silent' WHEN 2 THEN 'fail_fast' END"
    return users(spark, sf_dir).join(F.broadcast(_node_table(spark))).select(
        F.expr("concat('repo_', user_id)").alias("repo_id"), F.expr(FRAMEWORK).alias("framework"),
        "node_ord", "node_id", "node_type", "name", "class_name", "source_file", "line_number",
        F.expr(strategy).alias("error_handling_strategy"),
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(repo_id, edge_ord, edge_id, source, target, edge_type, condition)."""
    pairs = [(i, a[0], a[1], j, b[0], b[1]) for i, a in enumerate(NODES) for j, b in enumerate(NODES) if i != j]
    slots = values(spark, pairs, ["s", "source", "st", "t", "target", "tt"])  # the 72 possible slots of one graph
    return (
        users(spark, sf_dir).join(F.broadcast(slots), F.expr(EDGE_RULE)).select(
            F.expr("concat('repo_', user_id)").alias("repo_id"), F.expr("9 * s + t").alias("edge_ord"),
            F.expr("concat('e', s, '_', t)").alias("edge_id"), "source", "target",
            F.expr(EDGE_TYPE).alias("edge_type"),
            F.expr("CASE WHEN (s + 2 * t) % 6 = 0 THEN 'state.ok' END").alias("condition"),
        )
    )


def preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_preconditions(repo_id, framework, precondition)."""
    from spoor.constants import PRECONDITIONS

    ids = values(spark, list(enumerate(PRECONDITIONS)), ["i", "precondition"])
    return users(spark, sf_dir).join(F.broadcast(ids), F.expr(PRECONDITION_RULE)).select(
        F.expr("concat('repo_', user_id)").alias("repo_id"), F.expr(FRAMEWORK).alias("framework"), "precondition",
    )


# ---- the same tables for the checking engine --------------------------------
def _sql_nodes() -> str:
    rows = ", ".join(f"({i}, '{a}', '{b}', '{c}', '{d}', '{e}', {f})" for i, (a, b, c, d, e, f) in enumerate(NODES))
    return f"(VALUES {rows}) AS x(node_ord, node_id, node_type, name, class_name, source_file, line_number)"


def sql_ctes() -> dict[str, str]:
    """CTE name -> body; see `with_ctes`."""
    from spoor.constants import PRECONDITIONS

    body = (
        "SELECT event_id, user_id, event_type AS et, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, "
        "epoch_us(ts) AS us FROM events"
    )
    for layer in EVENT_LAYERS:
        body = f"SELECT *, {', '.join(f'{text} AS {name}' for name, text in layer)} FROM ({body})"
    pre = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PRECONDITIONS))
    return {
        "ev": body,
        "evl": "SELECT *, lag(event_id) OVER (PARTITION BY repo_id, run_id ORDER BY timestamp_ns, event_id) AS parent_id FROM ev",
        "users": "SELECT DISTINCT user_id FROM events",
        "tmpl": f"SELECT * FROM {_sql_nodes()}",
        "nodes": f"SELECT concat('repo_', user_id) AS repo_id, {FRAMEWORK} AS framework, tmpl.*, "
                 "CASE (node_ord + user_id) % 4 WHEN 0 THEN 'retry' WHEN 1 THEN 'fail_silent' WHEN 2 THEN 'fail_fast' END AS strategy "
                 "FROM users, tmpl",
        "edges": "SELECT repo_id, 9 * s + t AS edge_ord, concat('e', s, '_', t) AS edge_id, source, target, "
                 f"{EDGE_TYPE} AS edge_type, CASE WHEN (s + 2 * t) % 6 = 0 THEN 'state.ok' END AS condition FROM ("
                 "SELECT concat('repo_', user_id) AS repo_id, user_id, a.node_ord AS s, b.node_ord AS t, a.node_id AS source, "
                 "b.node_id AS target, a.node_type AS st, b.node_type AS tt FROM users, tmpl a, tmpl b) "
                 f"WHERE {EDGE_RULE}",
        "pre": f"SELECT concat('repo_', user_id) AS repo_id, {FRAMEWORK} AS framework, precondition "
               f"FROM users, (VALUES {pre}) AS y(i, precondition) WHERE {PRECONDITION_RULE}",
    }


_DEPENDS = {"evl": ["ev"], "nodes": ["users", "tmpl"], "edges": ["users", "tmpl"], "pre": ["users"]}


def with_ctes(sql: str, *names: str, recursive: bool = False) -> str:
    """Prefix a SELECT (or further CTEs ending in a SELECT) with the named shared tables."""
    ctes = sql_ctes()
    need: list[str] = []
    for n in names:
        for d in [*_DEPENDS.get(n, []), n]:
            if d not in need:
                need.append(d)
    head = ", ".join(f"{n} AS ({ctes[n]})" for n in need)
    rest = sql.strip()
    word = "WITH RECURSIVE " if recursive else "WITH "
    if rest.upper().startswith("WITH "):
        return f"{word}{head}, {rest[5:]}"
    return f"{word}{head} {rest}"
