"""Triage and semantic findings on small inputs."""

from pyspark.sql import functions as F

from spoor.operators import semantic as L
from spoor.operators import triage as T


def test_entry_points(spark):
    files = spark.createDataFrame([("r", p) for p in ("./main.py", "main.py", "pkg/__main__.py", "tests/b_test.py", "tests/a_test.py", "Examples/x.py", "notes.txt", None)] + [("s", "x.md")], "repo_id string, path string")
    packages = spark.createDataFrame([("r", "pkg"), ("s", "gone")], "repo_id string, primary_package string")
    commands = spark.createDataFrame([("r", 0, "a.b:main")], "repo_id string, ord int, entry_point string")
    got = [(r["repo_id"], r["rank"], r["path"], r["confidence"], r["command"]) for r in T.entry_points(files, packages, commands).orderBy("repo_id", "rank").collect()]
    assert got == [("r", 1, "a.b:main", 0.9, "python -m a/b"), ("r", 2, "main.py", 0.85, "python main.py"), ("r", 3, "pkg/__main__.py", 0.85, "python -m pkg"), ("r", 4, "Examples/x.py", 0.6, "python Examples/x.py"), ("r", 5, "tests/a_test.py", 0.5, "pytest tests/a_test.py -x --timeout=120")]
    extras = spark.createDataFrame([("r", "dev", ["a", "b"]), ("r", "all", ["b", None]), ("s", "x", None)], "repo_id string, extra string, dependencies array<string>")
    assert sorted(map(tuple, T.optional_dependencies(extras).collect())) == [("r", "a"), ("r", "b")]


def test_maturity(spark):
    cols = "repo_id string, is_organization boolean, website string, homepage string, public_repos int, contributors int, pushed_at string, readme string, license string"
    repos = spark.createDataFrame([("a", True, "w", None, 10, 5, "2024-05-30", "to production!", "ISC"), ("b", None, None, None, None, None, None, None, None), ("c", False, "w", "", None, 3, "2020-01-01", "reproduction", "gpl")], cols)
    files = spark.createDataFrame([("a", p) for p in (".circleci/config", "Chart.yaml", "x/OTEL.yml", ".env", "a.sealed-secret.yml", "spec/x")] + [("c", "testing.py"), ("c", None), ("z", "tests")], "repo_id string, path string")
    got = {r["repo_id"]: tuple(r)[1:] for r in T.maturity_scores(repos, files, F.expr("TIMESTAMP '2024-06-01'")).collect()}
    assert got == {"a": (30, 30, 30), "b": (0, 0, 0), "c": (0, 5, 0)}


def test_drifting_edges(spark):
    rows = [("r", "a", "b", 1, False, True, "x", None), ("r", "a", "b", 2, None, True, "y", False), ("r", "a", "b", 3, True, True, "y", True), ("r", "a", "c", 4, False, True, None, False), ("r", "c", "a", 5, False, True, None, False), ("r", "c", "a", 6, True, None, None, False)]
    df = spark.createDataFrame(rows, "repo_id string, source string, target string, ord int, hedging_preserved boolean, factual_additions boolean, mode string, failed boolean")
    assert [tuple(r) for r in L.drifting_edges(df).collect()] == [("r", "a", "b", 1.0, "x", 2)]
    assert L.drifting_edges(df.limit(0)).count() == 0


def test_node_semantics(spark):
    nodes = spark.createDataFrame([("r", "a"), ("r", "b")], "repo_id string, node string")
    stable = spark.createDataFrame([("r", "a", 0.2), ("r", "a", 0.4)], "repo_id string, node string, stability_score double")
    weak = spark.createDataFrame([("r", "x", 0.9)], "repo_id string, node string, vulnerability_score double")
    esc = spark.createDataFrame([("r", "a", "escalating", "low", None), ("r", "a", None, "odd", True), ("r", "a", "flat", None, False)], "repo_id string, node string, confidence_trajectory string, fabrication_risk string, compensatory_assertion boolean")
    got = {r["node"]: tuple(r)[2:] for r in L.node_semantics(nodes, stable, weak, esc).collect()}
    assert got["b"] == (None,) * 5 and got["a"][:2] == (0.4, None) and abs(got["a"][2] - 1 / 3) < 1e-9 and got["a"][3:] == ("low", True)
    assert L.boundary_patterns(spark.createDataFrame([("r", True), ("r", None), ("r", False)], "repo_id string, near_boundary boolean")).count() == 1
