"""Canonical event, graph and record schemas (fixed, never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


NODE_REF = _struct(node_type=S, node_id=S, node_name=S)

PAYLOAD = _struct(
    tool_name=S, status=S, input_tokens=L, output_tokens=L, error_type=S, error_message=S,
    latency_ms=D, error_handling=S, default_value_used=B, swallowed=B,
    selected_option_hash=S, outcome=S, confidence=D, input_hash=S, is_retry=B,
    action_prevented=B, bypassed=B, retry_triggered=B, false_positive=B,
    data_size_bytes=L, schema_mismatch=B, null_data=B, data=S, carries_error=B,
    downstream_impact=B, reached_irreversible=B, irreversible=B, condition_result=B, trigger=S,
    propagation_path=T.ArrayType(S), origin_node=S, terminal_node=S,
    agent_id=S, agent_name=S, source_node_id=S, target_node_id=S, delegation_type=S,
    delegation_id=S, node_id=S, error_node_id=S, state_key=S, access_type=S, accessor_node=S,
    source_node=S, target_node=S, routing_type=S, decision_basis=S, selected_target=S,
    output_hash=S, output_type=S, classification_fields=S, context_hash=S,
    context_source_node=S, has_classification_dependency=B,
    parent_node_id=S, input_source=S, tool_node_id=S, active_node_stack=T.ArrayType(S),
    agent_role=S, task_description=S, agent_goal=S, output_preview=S,
    last_user_message_preview=S, model_actual=S, model_requested=S,
)

EVENT = T.StructType([
    T.StructField("event_id", S), T.StructField("timestamp_ns", L), T.StructField("run_id", S),
    T.StructField("repo_id", S), T.StructField("framework", S), T.StructField("event_type", S),
    T.StructField("source_node", NODE_REF), T.StructField("target_node", NODE_REF),
    T.StructField("edge_type", S), T.StructField("payload", PAYLOAD),
    T.StructField("parent_event_id", S), T.StructField("stack_depth", L),
])

# One structural graph document: maps keyed by id, as the graph scanner writes them.
GRAPH_NODE = _struct(
    node_type=S, name=S, class_name=S, kind=S, source_file=S, line_number=L, service_domain=S,
    error_handling_strategy=S, taxonomy_preconditions=T.ArrayType(S),
)
GRAPH_EDGE = _struct(edge_type=S, source=S, target=S, condition=S)
GRAPH = T.StructType([
    T.StructField("repo_id", S), T.StructField("framework", S),
    T.StructField("taxonomy_preconditions", T.ArrayType(S)),
    T.StructField("nodes", T.MapType(S, GRAPH_NODE)),
    T.StructField("edges", T.MapType(S, GRAPH_EDGE)),
])

RUN_METADATA = _struct(
    repo_id=S, run_id=S, framework=S, status=S, exit_code=L, stderr=S, duration_seconds=D,
    tier=L, event_count=L, input_hash=S, model_name=S, run_number=L,
)
