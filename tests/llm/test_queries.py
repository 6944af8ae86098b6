"""Every operator query over whole tables against a brute-force version."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")
Q = entry.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(spark, name):
    return [r.asDict() for r in Q[name](spark, SF).collect()]


def test_secrets(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op2_secret_scan")}
    patterns = [
        ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    total = 0
    for i, text, _ in docs:
        spans = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(patterns) for m in p.finditer(text or "") if ok(m)]
        line = ",".join(x[2] for x in sorted(spans))
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in spans) for k in range(3)]
        assert ",".join(x for x in r["spans"].split(",") if x and not x.startswith("model")) == line
        total += len(spans)
    assert total and len(got) == len(docs)


def test_leaks(spark, docs):
    found = {(r["doc_id"], r["item_id"]): r for r in rows(spark, "op3_decontamination")}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    plain = lambda t: " " + " ".join(re.sub(r"[\x00-\x7f]", lambda m: m[0] if m[0].isalnum() else " ", (t or "").lower()).split()) + " "
    texts = {i: plain(t) for i, t, _ in docs}
    exact = {(i, j) for j, t in items if len(plain(t).split()) >= 4 for i in texts if plain(t) in texts[i]}
    assert exact and exact <= set(found)
    assert all(found[k]["score"] == 1.0 for k in exact)
    words = {j: plain(t).split() for j, t in items}
    for (i, j), r in found.items():  # what is reported shares at least half of the item's words, in order
        part = texts[i].split()[r["first_word"] : r["end_word"]]
        common = sum((Counter(part) & Counter(words[j])).values())
        assert r["score"] >= 0.5 and common >= len(words[j]) / 2


def test_sharding(spark, docs):
    got = rows(spark, "op4_sharding")
    text = {i: (t or "").encode() for i, t, _ in docs}
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    slots, sizes = defaultdict(list), Counter({s: 0 for s in range(24)})
    for r in got:
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    largest = max(r["size"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= max(largest, 0.02 * sum(sizes.values()) / 24)


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    from spoor.llm.queries import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: r for r in rows(spark, "op5_token_planes")}
    start = 0
    for i, text, _ in sorted(docs):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_mixing(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op6_mixing")}
    sizes = {i: len(split(t)) for i, t, _ in docs}
    per = defaultdict(list)
    for i, _, s in docs:
        per[s].append(i)
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    mass = {s: sum(sizes[i] for i in per[s]) for s in order}
    target, free, left = {}, set(order), 1.5 * sum(mass.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * mass[s]}
        for s in over or free:
            target[s] = 2.0 * mass[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    for s in order:
        taken = sum(got[i]["taken"] for i in per[s])
        some = sorted(sizes[i] for i in per[s])[len(per[s]) // 2]  # whole copies of a handful of documents come no nearer
        assert abs(taken - target[s]) <= max(0.01 * target[s], some), (s, taken, target[s])
        for i in per[s]:
            r = got[i]
            assert r["size"] == sizes[i] and r["source_size"] == mass[s] and 0 <= r["taken"] <= 2 * r["size"]
            assert r["target"] == pytest.approx(target[s])
    again = {r["doc_id"]: r["taken"] for r in rows(spark, "op6_mixing")}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_simhash(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op7_simhash")}
    prints = {}
    for i, t, _ in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in split(t)]
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert got[i]["fingerprint"] == f"{prints[i]:016x}"
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 4):
            a, b = root(i), root(ids[j])
            parent[max(a, b)] = min(a, b)
    assert {i: r["component_id"] for i, r in got.items()} == {i: root(i) for i in ids}


def test_nearest_vectors(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, vectors = np.array([r[0] for r in table]), np.array([r[1] for r in table], float)
    got = defaultdict(list)
    for r in rows(spark, "op8_nearest_vectors"):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        scores = vectors @ vectors[ids == q][0]
        order = [int(ids[k]) for k in np.lexsort((ids, -scores)) if ids[k] != q][:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        for _, v, s in mine:
            assert s == pytest.approx(scores[ids == v][0], abs=1e-12)
        hits += len(set(order) & {m[1] for m in mine})
        total += 20
    print("recall", hits / total)
    assert hits / total >= 0.9


def test_toxicity(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op9_toxicity")}
    assert len(got) == len(docs)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right, n = Counter(), Counter()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"] and i in labels:
            n[labels[i]] += 1
            right[labels[i]] += r["predicted"] == labels[i]
    print("held out", {y: (right[y], n[y]) for y in n})
    assert right[0] >= 0.95 * n[0]
    if n[1] >= 20:
        assert right[1] >= 0.8 * n[1]
