"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names for every operator."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from spoor.llm import components, decontaminate, mixing, neighbours, secrets, sharding, simhash, substring_dedup, token_store, toxicity, warc
from spoor.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, row_key string, size string, shard string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, "en", s, 1, 1, "k", "s", "h") for i, t, s in pairs], SCHEMA)


ODD = [(1, None, "a"), (2, "", "a"), (3, "   \t\n", None), (None, "one two", "b"), (5, LONG, "b"), (5, LONG, "b"), (6, "x", None), (6, "y", "a"), (7, " ".join(["same"] * 80), "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def test_substring_dedup(odd, none):
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["removed_spans"]) for r in substring_dedup.substring_dedup(odd, window=35).collect()))
    assert got == [(0, 2, 0, ""), (1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (5, 30_000, 30_000, "0:30000"), (5, 30_000, 30_000, "0:30000"), (6, 1, 0, ""), (6, 1, 0, ""), (7, 80, 80, "0:80")]
    assert substring_dedup.substring_dedup(none).count() == 0


def test_secrets(spark, none):
    d = docs(spark, [(1, None, "a"), (2, "", "a"), (3, "é password=secret:abcdefghijklmnop API_KEY: 'abcdefghijkl' x", None), (4, "AKIA" + "Z" * 14 + " AKIA" + "Z" * 13 + " " + "0af" * 6, "b"), (None, "token=abc", "b")])
    model = secrets.train(secrets.labelled_samples(d))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "model"] for r in secrets.scan(d, model).collect()}
    assert got[1] == got[2] == got[None] == []
    assert got[3] == [("assign", 35, 57)]  # a failing match takes its characters with it
    assert got[4] == [("access", 0, 18), ("hex", 37, 55)]
    assert secrets.scan(none, secrets.train(secrets.labelled_samples(none))).count() == 0


def test_secret_model(spark):
    rng = np.random.default_rng(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda: "".join(letters[i] for i in rng.integers(0, 62, 32))
    plain = ["get_customer_order_total_amount", "readConfigurationFromFile", "maximum_number_of_connections", "parseIncomingMessageHeader"] * 30
    model = secrets.train(spark.createDataFrame([(draw(), 1) for _ in range(120)] + [(p, 0) for p in plain], "token string, random int"))
    texts = docs(spark, [(1, f"see {draw()} here", "a"), (2, "call parse_customer_message_total now", "a")])
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan(texts, model).collect()}
    assert got == {1: ["model"], 2: []}


def test_decontamination(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    tests = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two"), (5, item)], "item_id long, text string")
    edited = item.replace("delta", "DELTA,").replace("kappa", "kilo").replace("pi ", "")
    d = odd.unionByName(docs(spark, [(20, f"before {item} after", "a"), (21, f"x y z {edited} q", "a"), (22, "alpha tau beta sigma gamma rho delta", "a"), (20, f"before {item} after", "a")]))
    got = sorted((r["doc_id"], r["item_id"], round(r["score"], 2)) for r in decontaminate.leaks(d, tests).collect())
    assert [g[:2] for g in got] == [(20, 1), (20, 1), (20, 5), (20, 5), (21, 1), (21, 5)]
    assert all(g[2] == 1.0 for g in got[:4]) and all(0.7 < g[2] < 1 for g in got[4:])
    assert decontaminate.drop_contaminated(d, tests).count() == d.count() - 3
    assert decontaminate.leaks(none, tests).count() == decontaminate.leaks(odd, tests.limit(0)).count() == 0


def test_edited_copies(spark, none):
    """Every edited copy that shares a seed is found with the score of brute force, whether its seeds are rare or not."""
    rng = np.random.default_rng(3)
    items = {i: [f"i{i}w{j}" for j in range(int(rng.integers(15, 60)))] for i in range(1, 41)}
    rows, want = [], {}
    for doc, share, times in [(1000, 0.10, 1), (2000, 0.15, 1), (3000, 0.20, 3), (4000, 0.25, 1)]:
        for i, words in items.items():
            copy = [f"e{doc}{i}x{j}" if rng.random() < share else w for j, w in enumerate(words)]
            copy = copy[: len(copy) // 2] + ["inserted"] * int(rng.integers(0, 9)) + copy[len(copy) // 2 :]
            for t in range(times):
                key = doc + 100 * t + i
                text = ["before"] * 30 + copy + [f"after{key}"] * 30
                rows.append((key, " ".join(text), "a"))
                numbers = {w: n for n, w in enumerate(dict.fromkeys(words))}
                best, _ = decontaminate.smith_waterman(np.arange(len(words))[None], np.array([[numbers.get(w, -2) for w in text]]))
                seeds = {tuple(words[j : j + 4]) for j in range(len(words) - 3)}
                if best[0] >= len(words) and any(tuple(text[j : j + 4]) in seeds for j in range(len(text) - 3)):
                    want[key, i] = best[0] / (2 * len(words))
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(docs(spark, rows), tests).collect()}
    assert len(want) > 150 and got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.lists(st.integers(0, 4), min_size=1, max_size=12))
def test_smith_waterman(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i, j] = max(0, best[i - 1, j - 1] + (2 if x == y else -1), best[i - 1, j] - 1, best[i, j - 1] - 1)
    score, _ = decontaminate.smith_waterman(np.array([a]), np.array([b]))
    assert score[0] == best.max()


def test_sharding(spark, odd, none):
    out = corpus_pipeline.to_shards(spark, odd, "")
    assert out.count() == len(ODD) and set(out.columns) == {*odd.columns, "slot"}
    assert corpus_pipeline.to_shards(spark, none, "").count() == 0
    hot = spark.range(3000).selectExpr("10L as bytes", "case when id % 3 = 0 then 7L else xxhash64(id) end as k", "xxhash64(id, 1) as t")
    sizes = [r["count"] for r in sharding.shard(hot, "bytes", "k", "t", 8).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.05 * 3000 / 8  # a third of all rows has one key


def test_tokens(spark, odd, none, tmp_path):
    token_store.write_tokens(odd, f"{tmp_path}/t", tokenizer_path())
    got = sorted(((r["doc_id"] or 0, len(r["ids"])) for r in token_store.read_tokens(spark, f"{tmp_path}/t").collect()))
    assert len(got) == len(ODD) and got[:3] == [(0, 3), (1, 1), (2, 1)]
    starts = sorted((r["start"], r["n_tokens"]) for r in token_store.read_token_summaries(spark, f"{tmp_path}/t").collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    token_store.write_tokens(none, f"{tmp_path}/n", tokenizer_path())
    assert token_store.read_token_summaries(spark, f"{tmp_path}/n").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=6), st.booleans())
def test_segment_round_trip(texts, bits):
    data = token_store.pack_segment([None if i == 1 else i for i in range(len(texts))], [np.array(t, np.uint32) for t in texts], bits, block=16)
    keys, counts, ids = token_store.unpack_segment(data)
    assert keys == [None if i == 1 else i for i in range(len(texts))]
    assert counts.tolist() == [len(t) for t in texts] and ids.tolist() == [x for t in texts for x in t]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab Z9.,'!\n\t\r\x01\x0b\x1c\x85\xa0 é́😀<|>")), max_size=40))
def test_pieces_equal_whole(text):
    e = token_store.PieceEncoder.loaded(tokenizer_path())
    assert e.encode(pa.array([text, None]))[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_mixing(spark, odd, none):
    out = corpus_pipeline.mix_sources(spark, odd, "")
    assert out.columns == odd.columns and out.count() >= len(ODD)
    assert corpus_pipeline.mix_sources(spark, none, "").count() == 0
    rows = spark.createDataFrame([(10, "a", 1), (0, "b", 2), (0, None, 3)], "n long, s string, k long")
    got = {r["s"]: (r["target"], r["taken"]) for r in mixing.mix(rows, "n", "s", "k").collect()}
    assert got == {"a": (15.0, 10), "b": (0.0, 0), None: (0.0, 0)} or got["a"] == (15.0, 20)


def test_simhash(spark, odd, none):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_groups(odd).collect()}
    assert {k[0]: v for k, v in got.items() if k[1] == "0" * 16} == {1: 1, 2: 1, 3: 1}
    assert sum(k[0] == 5 for k in got) == 1 and all(v == 5 for k, v in got.items() if k[0] == 5)
    kept = simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 5, 6, 6, 7]
    assert simhash.simhash_groups(none).count() == simhash.keep_one_per_group(none).count() == 0


def test_stars_and_masks():
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    values = np.concatenate([base, base ^ np.int64(5), base ^ np.int64(-(2**63))])
    left = {int(v): int(c) for v, c in simhash.stars(values, 4)}
    assert len(left) == 80
    for n in (10, 10**5, 10**7):
        masks = simhash.block_masks(n, 4)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not flips & m for m in masks)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] != got[0] and len(got) == 63


def test_nearest(spark):
    rows = [(i, [float(np.cos(i)), float(np.sin(i))], 1) for i in range(30)] + [(40, None, 1), (41, [0.0, 0.0], 1), (42, [float("nan"), 1.0], 1), (43, [1.0, None], 1), (None, [1.0, 1.0], 1), (3, [float(np.cos(3)), float(np.sin(3))], 2), (50, [float(np.cos(2)), float(np.sin(2))], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int")
    out = neighbours.nearest(v, v.filter("vec_id in (0, 2, 40)"), k=50).collect()
    by = {q: [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in out}}
    assert set(by) == {0, 2} and len(by[0]) == 30 and 0 not in by[0] and by[2][0] == 50 and by[0].index(2) < by[0].index(50)
    assert neighbours.nearest(v.limit(0), v).count() == neighbours.nearest(v, v.limit(0)).count() == 0


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 200)] + [(None, 1), (100, None)], "doc_id long, toxic int")
    texts = docs(spark, [(i, "Fine words here. " + ("You zorgle! " if i % 2 else "You there. ") + "More words follow.", "a") for i in range(100, 200)])
    model = toxicity.train(texts, labels)
    got = {r["doc_id"]: r for r in toxicity.score(texts, "text", model, "score", "found").collect()}
    assert all((r["score"] >= 0.5) == bool(i % 2) for i, r in got.items())
    assert [s["sentence"] for s in got[101]["found"]] == [1] and not got[100]["found"]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(odd, "text", model).collect()}
    assert scores[1] == scores[2] == scores[3] == 0.0
    assert toxicity.score(none, "text", toxicity.train(none, labels)).count() == 0


def test_long_clean_text(spark):
    """Length alone makes no text toxic, and one telling line among many still does."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 200)], "doc_id long, toxic int")
    texts = docs(spark, [(i, "Fine words here. " + ("You zorgle! " if i % 2 else "You there. ") + "More words follow.", "a") for i in range(100, 200)])
    model = toxicity.train(texts, labels)
    lines = [f"{i}" for i in range(50_000)]
    long = docs(spark, [(1, "\n".join(lines), "a"), (2, "\n".join(["fine words"] * 50_000), "a"), (3, "\n".join([*lines, "you zorgle"]), "a")])
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(long, "text", model).collect()}
    assert scores[1] < 0.05 and scores[2] < 0.05 and scores[3] >= 0.5


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>", 1), (2, "http://b\r\nX: y", "<p>x</p>", 1), (3, None, None, 1), (4, "http://d", "", 1), (None, "http://e", "é\r\n\r\nWARC/1.1\r\n", 1), (5, "u", "dup", 1), (5, "u", "dup", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    warc.write_warc(pages, f"{tmp_path}/w")
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, f"{tmp_path}/w").collect()), key=str)
    assert got == sorted([(0, 16, "response", None), (1, 8, "revisit", 2), (2, 8, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 3, "response", None), (5, 3, "revisit", 5)], key=str)
    warc.write_warc(pages, f"{tmp_path}/m", min_bytes=4)
    assert sum(r["record_type"] == "revisit" for r in warc.read_warc(spark, f"{tmp_path}/m").collect()) == 1
    warc.write_warc(pages.limit(0), f"{tmp_path}/n")
    assert warc.read_warc(spark, f"{tmp_path}/n").count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns, name
        assert stage(spark, none, sf).count() == 0, name
