"""Exact dedup, periodic runs and whitening: brute force on whole tables, and the odd cases."""

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
import corpus_pipeline
from spoor.llm import content_sort, runs, whitening

SF = "/root/testdata/sf0.001"
Q = entry.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def plain_runs(w):
    """Every maximal stretch of equal words q apart, by trying all q."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        i = 0
        while i < len(same):
            j = same.index(False, i)
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(w[i : i + n - p] == w[i + p : i + n] for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(i, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
    if plant and h % 10 == 0 and n:
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    drop = {k for s, m, q in found for k in range(s + q, s + m)}
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(x for k, x in enumerate(w) if k not in drop)
    return (i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_whole_table(spark, docs):
    got = {r["doc_id"]: tuple(r) for r in Q["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    short = [(i, t) for i, t in docs if len((t or "").split()) <= 1500]
    assert len(short) > 0.9 * len(docs) and sum(got[i][1] > 0 for i, _ in short) > 5
    for i, t in short:
        assert got[i] == plain_row(i, t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=30), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=4)), min_size=1, max_size=4))
def test_runs_by_brute_force(parts):
    texts = [head * times + tail for head, times, tail in parts]
    words = np.array([x for t in texts for x in t], np.int64)
    which = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    want, at = [], 0
    for t in texts:
        want += [(s + at, n, q) for s, n, q in plain_runs(t)]
        at += len(t)
    assert runs.find_runs(words, which) == want


SCHEMA = "doc_id long, text string, range_no string, run string, n long, row_no string, x string, start string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, " "), (None, "one two"), (5, LONG), (5, LONG), (6, "one\n two"), (6, "y"), (7, " ".join(["same"] * 80)), (None, "only null"), (8, "ab ab ab ab"), (9, "a b a b a b a b")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "r", "u", 1, "n", "x", "s") for i, t in rows], SCHEMA)


def test_runs_odd_cases(spark):
    got = sorted(runs.collapse_runs(table(spark, ODD), batch_words=50).drop("runs").collect(), key=lambda r: (r[0] or 0, str(r)))
    want = sorted((plain_row(i, t, plant=False) for i, t in ODD if t != LONG), key=lambda r: (r[0] or 0, str(r)))
    assert [tuple(r) for r in got if r[0] != 5] == want and [r["n_runs"] for r in got if r[0] == 5] == [0, 0]
    assert runs.collapse_runs(table(spark, [])).count() == 0


def test_one_long_repetition(spark):
    """A whole text of one word, and one that repeats a third of itself, cost no more than others."""
    got = runs.collapse_runs(table(spark, [(1, "a " * 200_000), (2, " ".join(f"v{i % 1000}" for i in range(100_000)))])).collect()
    assert {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"]) for r in got} == {1: (1, 0, 200_000, 1), 2: (1, 0, 100_000, 1000)}


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        order = known + [None] * (len(ids) - len(known))
        out += [(i, order[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(order)]
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [False, True])
def test_exact_groups(spark, docs, few):
    rows = ODD * 2 if few else docs
    got = content_sort.exact_groups(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == plain_groups(rows)


def test_hot_text_fills_many_ranges(spark):
    """Copies of one text are cut by row, and the groups over range ends come together again."""
    rows = [(i, "the same text" if i % 3 else f"text {i % 40}") for i in range(3000)]
    data = table(spark, rows)
    numbered = data.select("doc_id", "text").selectExpr("*", "doc_id as row_no")
    cuts = content_sort.splitters(numbered, "doc_id", content_sort.normalise(numbered["text"]), "row_no", 30)
    assert sum(c[0] == "the same text" for c in cuts) >= 15
    assert sorted(map(tuple, content_sort.exact_groups(data).collect()), key=str) == plain_groups(rows)


def test_exact_dedup_of_nothing(spark):
    assert content_sort.exact_groups(table(spark, [])).count() == 0
    assert content_sort.keep_first(table(spark, [])).count() == 0


def test_keep_first(spark):
    kept = content_sort.keep_first(table(spark, ODD))
    assert kept.columns == table(spark, []).columns
    want = {(5, LONG), (1, None), (3, " \t\n"), (6, "one\n two"), (6, "y"), (7, ODD[9][1]), (None, "only null"), (8, ODD[11][1]), (9, ODD[12][1])}
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == want and kept.count() == len(want)


def plain_whitening(vectors, k=16):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    u = np.unique(np.array(x, np.int64), axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    deviation = [sum((n * a - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return n, deviation, (np.array(x) - s / n) @ (v[:, :k] / np.sqrt(e[:k])), e[:k] / e.sum()


def check_whitening(got, ids, vectors, k=16):
    n, deviation, white, share = plain_whitening(vectors, k)
    at = {i: j for j, i in enumerate(ids)}
    mine = np.full(white.shape, np.nan)
    for r in got:
        j = at[r["vec_id"]]
        mine[j, r["component"] - 1] = r["whitened"]
        assert (r["n"], r["deviation"]) == (n, deviation[j]) and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-9)
    assert len(got) == white.size
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-7


def test_whitening_of_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [r for r in rows if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    check_whitening(Q["op13_whitening"](spark, SF).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_whitening_odd_cases(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=5).round(3).tolist()) for i in range(30)]
    good += [(30, good[0][1]), (31, good[0][1]), (32, [0.5, 1.0])]  # repeated vectors count once, a short one is filled up
    bad = [(40, None), (41, [1.0, None, 2.0, 0.0, 0.0]), (42, [float("nan")] * 5), (43, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, x string, at string, v string"
    rows = [(i, v, "x", "a", "v") for i, v in good + bad]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    check_whitening(got, [i for i, _ in good], [v + [0.0] * (5 - len(v)) for _, v in good])
    for few in ([], rows[-4:], rows[:1], [rows[0], rows[30]]):
        assert whitening.whiten(spark.createDataFrame(few, schema)).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0], "", "", ""), (2, [0.0, 1.0], "", "", ""), (None, [3.0, -1e300], "", "", "")], schema)
    assert {r["vec_id"] for r in whitening.whiten(huge).collect()} == {1, 2, None}


def test_eigenvectors_of_a_low_rank(spark):
    rng = np.random.default_rng(4)
    x = (rng.integers(-50, 50, (400, 3)) @ rng.integers(-5, 5, (3, 60))).astype(np.int64) + 1_000_000
    fit = spark.createDataFrame([(r,) for r in np.unique(x, axis=0).tolist()], "x array<long>")
    model = whitening.fit_components(fit, 16)
    assert len(model.values) == 3 and whitening.measure(fit, model) < 1e-8


CLASH = "doc_id long, text string, lang string, source string, n_chars long, total long, rows long, shard_no int, slot_no int, first_piece int, piece_count int, first_slot long, key string, size string, row_key string, copies long, Slot int"


def test_stages_with_clashing_names(spark):
    rows = [(i, f"word{i} " * 5, "en", "a", 1, 7, 7, 7, 7, 7, 7, 7, "k", "s", "r", 7, 7) for i in range(20)]
    mixed = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, CLASH), "")
    assert mixed.count() == 30 and {r["total"] for r in mixed.collect()} == {7}
    out = corpus_pipeline.to_shards(spark, spark.createDataFrame(rows, CLASH), "").collect()
    assert len(out) == 20 and all(r["slot_no"] == r["shard_no"] == r["first_slot"] == r["copies"] == 7 for r in out)


def test_mixing_keeps_the_sum_of_repeated_rows(spark):
    """Rows that are equal in every column take their source's target together."""
    rows = [(None, "w " * (5 + i % 50), "en", "a" if i % 4 else "b", None) for i in range(200) for _ in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    words = defaultdict(int)
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        words[r["source"]] += len(r["text"].split())
    mass = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "ab"}
    a = min(1.5 * sum(mass.values()) * 5 / 7, 2 * mass["a"])
    target = {"a": a, "b": min(2 * mass["b"], 1.5 * sum(mass.values()) - a)}
    assert all(abs(words[s] - target[s]) <= 10 for s in "ab")
