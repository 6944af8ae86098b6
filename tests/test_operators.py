"""Operators on small hand-made inputs, with expected values worked out by hand."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from spoor.functions import pvalues, stats, text
from spoor.operators import fingerprint, graph, motifs, outputs, quality, resolve, selection, semantic
from spoor.operators import source_scan as scan
from spoor.schema import EVENT
from spoor.sources import jsonl
from spoor.streaming import events as streams


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first()["x"] if values else spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("name,want", [("ResearchLead", "research_lead"), ("HTTPServer Agent", "http_server_agent"), ("web-search  tool", "web_search_tool"), ("_x_", "x"), ("GPT4Writer", "gpt4_writer")])
def test_normalize_name(spark, name, want):
    assert one(spark, text.normalize_name(F.col("n")), n=name) == want


NODES = [("r", "agent_planner", 0, "Planner", "Planner", "a.py", 1), ("r", "agent_writer_crew", 1, "Writer", "WriterThing", "a.py", 2), ("r", "cap_Search_tool", 2, "Web Search", "SearchTool", "t.py", 9), ("r", "ds_vector_store", 3, "Vectors", "Store", "s.py", 4)]


@pytest.mark.parametrize("rid,name,want", [
    ("agent_planner", "", "agent_planner"), ("crewai:Planner:src/a.py:5", "", "agent_planner"), ("crewai:Writer:src/x.py:5", "", "agent_writer_crew"), ("crewai:Zed:src/t.py:9", "", "cap_Search_tool"),
    ("", "planner", "agent_planner"), ("", "Search Tool", "cap_Search_tool"), ("", "Vector Store", "ds_vector_store"), ("", "writer_c", "agent_writer_crew"), ("ghost", "", None)])
def test_resolution_order(spark, rid, name, want):
    nodes = spark.createDataFrame(NODES, "repo_id string, node_id string, node_ord int, name string, class_name string, source_file string, line_number long")
    refs = spark.createDataFrame([("r", rid, name)], "repo_id string, ref_id string, ref_name string")
    got = resolve.resolve_refs(refs, nodes).collect()
    assert (got[0]["node_id"] if got else None) == want


def test_containing_equals_all_pairs(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc_") for _ in range(r.randint(0, 5)))
    a, b = sorted({word() for _ in range(40)}), sorted({word() for _ in range(40)})
    got = resolve.containing(spark.createDataFrame([("k", x) for x in a], "k string, x string"), spark.createDataFrame([("k", y) for y in b], "k string, y string"), ["k"], "x", "y")
    assert {(g["x"], g["y"]) for g in got.collect()} == {(x, y) for x in a for y in b if x in y or y in x}


def test_jsonl_layouts_and_quarantine(spark, tmp_path):
    nested = {"event_id": "1", "timestamp_ns": 5, "run_id": "r", "repo_id": "p", "event_type": "agent.task_start", "source_node": {"node_type": "agent", "node_id": "a", "node_name": "A"}, "payload": {"status": "success"}}
    flat = {"event_id": "2", "timestamp": "2024-01-01T00:00:01Z", "run_id": "r", "repo_id": "p", "event_type": "agent.task_end", "node_id": "fw:B:f.py:1", "output_preview": "done", "tool_name": "t"}
    missing = {"event_id": "3", "event_type": "x"}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "events_run_2.jsonl").write_text("\n".join([json.dumps(nested), "", json.dumps(flat), "{broken", "[1]", json.dumps(missing)]))
    good, bad = jsonl.read_events(spark, str(tmp_path))
    got = {r["event_id"]: r for r in good.collect()}
    assert set(got) == {"1", "2"} and got["1"]["source_node"]["node_name"] == "A" and got["1"]["run_number"] == 2
    assert got["2"]["source_node"]["node_id"] == "fw:B:f.py:1" and got["2"]["timestamp_ns"] == 1704067201000000000 and got["2"]["payload"]["output_preview"] == "done"
    assert sorted(r["corrupt"] for r in bad.collect()) == [False, True, True]


def test_graph_documents(spark, tmp_path):
    doc = {"framework": "crewai", "nodes": {"b": {"node_type": "agent", "name": "B"}, "a": {"node_type": "external", "name": "A"}}, "edges": {"e1": {"source": "b", "target": "a", "edge_type": "calls"}}}
    (tmp_path / "repo_x.json").write_text(json.dumps(doc))
    nodes, edges = jsonl.read_graphs(spark, str(tmp_path))
    assert [(r["repo_id"], r["node_id"], r["node_ord"]) for r in nodes.orderBy("node_ord").collect()] == [("repo_x", "b", 0), ("repo_x", "a", 1)]
    assert edges.first()["target"] == "a"


def _edges(spark, pairs, kind="delegates_to"):
    return spark.createDataFrame([("r", i, f"e{i}", s, t, kind) for i, (s, t) in enumerate(pairs)], "repo_id string, edge_ord int, edge_id string, source string, target string, edge_type string")


def _random_pairs(seed, n=7, p=0.3):
    r = random.Random(seed)
    return [(f"n{a}", f"n{b}") for a in range(n) for b in range(n) if a != b and r.random() < p]


def _bfs(pairs, start):
    order, queue, depth = [], [start], {start: 0}
    while queue:
        u = queue.pop(0)
        for s, t in pairs:
            if s == u and t not in depth:
                depth[t] = depth[u] + 1
                order.append(t)
                queue.append(t)
    return order, depth


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_order_and_longest_path(spark, seed):
    pairs = _random_pairs(seed)
    e = _edges(spark, pairs)
    got = {(r["origin"], r["node"]): r["depth"] for r in graph.reach(e).collect()}
    want = {(o, n): d for o in {s for s, _ in pairs} for n, d in _bfs(pairs, o)[1].items() if n != o}
    assert got == want
    first = {}
    for r in sorted(graph.breadth_first(e).collect(), key=lambda r: (r["origin"], r["depth"], list(r["via"]))):
        first.setdefault(r["origin"], []).append(r["node"])
    assert first == {o: _bfs(pairs, o)[0] for o in first}

    def longest(u, seen):
        return 1 + max((longest(t, seen | {t}) for s, t in pairs if s == u and t not in seen), default=0)

    assert graph.longest_path(e).first()["nodes"] == max(longest(s, {s}) for s, _ in pairs)


@pytest.mark.parametrize("seed", [3, 4])
def test_simple_cycles(spark, seed):
    pairs = _random_pairs(seed, 6, 0.35)
    found = set()

    def walk(path):
        for s, t in pairs:
            if s == path[-1]:
                if t == path[0]:
                    found.add(tuple(path))
                elif t > path[0] and t not in path:
                    walk(path + [t])

    for n in {s for s, _ in pairs}:
        walk([n])
    assert {tuple(r["cycle"]) for r in graph.simple_cycles(_edges(spark, pairs)).collect()} == found
    loops = set()
    for s, t in pairs:
        if s == t:
            loops.add((s,))
        ways = [[t]]
        while s != t and ways and not any(w[-1] == s for w in ways):
            ways = [w + [y] for w in ways for x, y in pairs if x == w[-1] and y not in w]
        for w in sorted(w for w in ways if w[-1] == s)[:1]:
            loops.add(tuple(w[w.index(min(w)):] + w[:w.index(min(w))]))
    got = [tuple(r["cycle"]) for r in graph.shortest_cycles(_edges(spark, pairs)).collect()]
    assert sorted(got) == sorted(loops) and bool(got) == bool(found)


def test_cosine_and_nearest(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [0.0, 2.0])], "id long, vec array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, qvec array<double>")
    got = [(r["id"], round(r["similarity"], 4)) for r in fingerprint.nearest(q, base, k=2).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.7071)]


CODE = '''class Out(BaseModel):
    size: int
# filler
agent = Agent(role="Lead", goal='plan {x}')
def work(text):
    text = text.strip()
    try:
        crew.kickoff(timeout=90)
    except (ValueError, KeyError) as e:
        logging.error(e)
        raise
    except:
        pass
    prompt = "do NOT guess"
    do NOT count me
    state["draft"] = state.step
'''


def test_source_scan(spark):
    files = spark.createDataFrame([("r", "src/a.py", CODE)], "repo_id string, path string, content string")
    got = {(m["line_number"], m["category"], m["kind"]): m for m in scan.scan_patterns(files).collect()}
    assert (1, "output_validation", "pydantic_model") in got and (6, "input_sanitization", "strip") in got and got[(6, "input_sanitization", "strip")]["flag"]
    assert got[(8, "timeout_iteration_guards", "timeout")]["value"] == 90
    specific, bare = got[(9, "exception_handling_topology", "specific")], got[(12, "exception_handling_topology", "bare")]
    assert specific["flag"] and specific["value"] == 2 and not bare["flag"] and bare["value"] == 1
    assert (14, "prompt_constraints", "prohibition") in got and (15, "prompt_constraints", "prohibition") not in got
    assert {r["key"] for r in scan.state_keys(files).collect()} == {"draft", "step", "size"}
    d = scan.definitions(files, "Agent", ["role", "goal"], "role").first()
    assert (d["role"], d["goal"]) == ("Lead", "plan example")


@pytest.mark.parametrize("prefix,want", [("", False), ('x = "', True), ("x = 'a' + ", False), ('"""', True), ('"it\'s ', True), ("'''a''' ", False)])
def test_in_string(spark, prefix, want):
    assert one(spark, scan.in_string(F.col("p")), p=prefix) is want


def test_output_and_error_classes(spark):
    df = spark.createDataFrame([('{"a": 1, "label": "spam", "b": 22}',), ("I cannot do that for you today",), ("short",)], "t string")
    assert [r["primary"] for r in outputs.classify_output(df, "t").collect()] == ["structured", "refusal", "error_empty"]
    sig = outputs.output_signature(df, "t").collect()
    assert sig[0]["content_type"] == "classification" and sig[0]["classification_fields"] == {"label": "spam"} and sig[1]["content_type"] == "short_text"
    assert one(spark, outputs.error_class(F.col("m")), m="Request timed out") == "timeout"
    assert one(spark, outputs.error_class(F.col("m"), F.lit("KeyError")), m="oops") == "schema_mismatch"


def test_error_message(spark):
    log = "a\nTraceback x\nold\nb\n  Traceback (most recent)\n  File\nValueError: no"
    assert one(spark, quality.error_message(F.col("s")), s=log) == "Traceback (most recent)\n  File\nValueError: no"
    assert one(spark, quality.error_message(F.col("s")), s="1\n2\n3\n4\n5\n6") == "2\n3\n4\n5\n6"


def test_statistics(spark):
    low, high = stats.wilson(F.lit(8), F.lit(10))
    assert one(spark, low) == pytest.approx(0.4901625, abs=1e-6) and one(spark, high) == pytest.approx(0.9433178, abs=1e-6)
    df = spark.createDataFrame([(2.228139, 10.0, 3.841459)], "t double, df double, x double")
    r = df.select(pvalues.student_p(F.col("t"), F.col("df")).alias("p"), pvalues.chi2_p(F.col("x")).alias("q")).first()
    assert r["p"] == pytest.approx(0.05, abs=1e-6) and r["q"] == pytest.approx(0.05, abs=1e-6)
    assert math.isclose(one(spark, pvalues.pearson_p(F.lit(0.576), F.lit(12))), 0.05, abs_tol=2e-3)


def test_semantic_answers(spark):
    df = spark.createDataFrame([(1, '{"hedging_preserved": true, "scope_preserved": true, "factual_additions_detected": true, "extra": 1}')], "id int, a string")
    r = semantic.answers(df, "a", 1).withColumn("score", semantic.fidelity_score()).first()
    assert r["mast_failure_mode"] == "unknown" and r["score"] == pytest.approx(0.35)


def test_discovery_equals_greedy(spark):
    r = random.Random(9)
    repos = [{"repo_id": f"r{i:03d}", "framework": r.choice(["crewai", "agno", "odd"]), "agent_count": r.randint(0, 9), "finding_ids": r.sample(list(selection.FINDING_TARGETS), r.randint(0, 3)), "present_control_types": r.sample(list(selection.CONTROLS), r.randint(0, 2)),
              "topology_hash": r.choice(["a", "b", "c", "d", ""]), "estimated_runnability": r.randint(0, 100) / 100, "xcomp_findings": ["x"] if r.random() < 0.2 else []} for i in range(120)]

    def value(p, counts, seen):
        gap = lambda k, n: max(0.0, 1 - counts.get(k, 0) / n)
        v = 0.0 if not p["topology_hash"] else 1.0 if p["topology_hash"] in seen else 15.0
        v += 10 * gap("fw_" + p["framework"], selection.FRAMEWORK_MIN.get(p["framework"], 20))
        b = next((n for n, (lo, hi, _) in selection.COMPLEXITY.items() if lo <= p["agent_count"] <= hi), None)
        v += 8 * gap("cx_" + b, selection.COMPLEXITY[b][2]) if b else 0
        v += sum((12 if "XCOMP" in f else 6) * gap("finding_" + f, selection.FINDING_TARGETS[f]) for f in p["finding_ids"])
        v += sum(4 * (gap("ctrl_with_" + c, w) if c in p["present_control_types"] else gap("ctrl_without_" + c, wo)) for c, (w, wo) in selection.CONTROLS.items())
        return round(v * (0.5 + 0.5 * p["estimated_runnability"]) + (8 if p["xcomp_findings"] else 0), 9)

    counts, seen, left, picked = {}, set(), list(repos), []
    for i in range(60):
        if i < 20 or i % 50 == 0:
            left.sort(key=lambda p: (-value(p, counts, seen), p["repo_id"]))
        p = left.pop(0)
        picked.append(p["repo_id"])
        band = next((b for b, (lo, hi, _) in selection.COMPLEXITY.items() if lo <= p["agent_count"] <= hi), None)
        for k in [f"fw_{p['framework']}", *([f"cx_{band}"] if band else []), *[f"finding_{f}" for f in p["finding_ids"]], *[f"ctrl_with_{c}" for c in p["present_control_types"]]]:
            counts[k] = counts.get(k, 0) + 1
        seen |= {p["topology_hash"]} - {""}
    df = spark.createDataFrame([tuple(p.values()) for p in repos], "repo_id string, framework string, agent_count int, finding_ids array<string>, present_control_types array<string>, topology_hash string, estimated_runnability double, xcomp_findings array<string>")
    got = [r["repo_id"] for r in selection.select_for_discovery(df, 60).orderBy("pick").collect()]
    assert got == picked


def test_stream_running_depth(spark, tmp_path):
    kinds = [("delegation.initiated", 1), ("delegation.initiated", 1), ("agent.task_end", -1), ("agent.task_end", -1), ("agent.task_end", -1), ("delegation.initiated", 1)]
    rows = [json.dumps({"event_id": f"{i}", "timestamp_ns": 1704067200000000000 + i, "run_id": "a", "repo_id": "r", "event_type": k}) for i, (k, _) in enumerate(kinds)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("\n".join(rows))
    out = streams.running_depth(streams.event_stream(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("depths").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["depth"], r["max_depth"]) for r in spark.table("depths").collect()] == [(1, 2)]


def test_token_counters_by_any_name(spark, tmp_path):
    base = {"timestamp_ns": 5, "run_id": "r", "repo_id": "p", "event_type": "llm.call_end"}
    rows = [{"payload": {"input_tokens": 7, "prompt_tokens": 9}}, {"payload": {"prompt_tokens": 3, "completion_tokens": 4}}, {"completion_tokens": 6, "latency_ms": 2.5}, {"payload": {"latency_ms": 1.5}, "latency_ms": 9.0}]
    (tmp_path / "events_run_1.jsonl").write_text("\n".join(json.dumps(base | {"event_id": str(i)} | r) for i, r in enumerate(rows)))
    got = {r["event_id"]: (r["payload"]["input_tokens"], r["payload"]["output_tokens"], r["payload"]["latency_ms"]) for r in jsonl.read_events(spark, str(tmp_path))[0].collect()}
    assert got == {"0": (7, None, None), "1": (3, 4, None), "2": (None, 6, 2.5), "3": (None, None, 1.5)}


def test_event_schema_is_fixed():
    assert EVENT.names[:4] == ["event_id", "timestamp_ns", "run_id", "repo_id"] and "payload" in EVENT.names
