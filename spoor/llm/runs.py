"""Periodic runs of words by descending-LCP Kruskal.

A run of period q and at least four periods holds two suffixes q apart with a common prefix (LCP) of three
periods. So suffixes are kept whose first five words (the least LCP a run can have) recur in the same text,
sorted by prefix doubling, and united from the longest LCP down with union-find over ordered position sets.
Positions that become neighbours in a set, at distance q within the LCP, seed a run; a seed whose word on
the left differs is the run's start, and its LCP gives the end. Texts are independent: batches of whole
texts are worked on inside a scan, nothing is shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import split_words, thrifty

LEAST, PERIODS = 6, 4
SEED_LCP = 5  # a run of period 1 has 6 words, so LCP 5; period q has LCP 3 q, 6 or more from q = 2 on
BATCH_WORDS = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from a on repeat the first p of them, for every tenth id by crc32; else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def repeated_seeds(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Positions whose SEED_LCP words recur within their text; by hash, so a few more at worst."""
    m = len(words) - SEED_LCP + 1
    if m < 2:
        return np.zeros(0, np.int64)
    h = text[:m].astype(np.uint64) * MIX
    for i in range(SEED_LCP):
        h = (h ^ words[i : i + m].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    inside = np.flatnonzero(text[:m] == text[SEED_LCP - 1 :])
    h = h[inside]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(len(h), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return inside[hit]


def _groups(keys: list[np.ndarray], base: np.ndarray) -> np.ndarray:
    """For each tuple of `keys`, `base` of the first of its equals plus the tuples sorted before it there."""
    order = np.lexsort(keys[::-1])
    opens = np.ones(len(order), bool)
    opens[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    start = np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))
    # Tuples that share a base stand together, so the place within the base is a difference of places.
    sorted_base = base[order]
    first = np.ones(len(order), bool)
    first[1:] = sorted_base[1:] != sorted_base[:-1]
    origin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    out = np.empty(len(order), np.int64)
    out[order] = sorted_base + start - origin
    return out


def suffix_order(words: np.ndarray, text: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes `spots` sorted by text, then words, and the LCP of each with the one before it.

    `spots` holds every position whose first SEED_LCP words recur in its text. LCPs below SEED_LCP or across
    texts are reported as 0.
    """
    total = len(words)
    # Where w words of a suffix recur, the SEED_LCP words before position + w recur too: what follows a spot
    # is a spot or stands SEED_LCP words behind one.
    known = np.union1d(spots, spots + SEED_LCP)
    known = known[known < total]
    known = known[(known < SEED_LCP) | np.isin(known, spots) | (text[known] == text[known - SEED_LCP])]
    keys = [text[known]]
    for i in range(SEED_LCP):
        at = np.minimum(known + i, total - 1)
        keys.append(np.where((known + i < total) & (text[at] == text[known]), words[at], -1))
    rank = _groups(keys, np.zeros(len(known), np.int64))
    width, levels = SEED_LCP, []
    while True:
        place = np.full(total + 1, -1, np.int64)
        place[known] = rank
        levels.append((width, place))
        _, back, count = np.unique(rank, return_inverse=True, return_counts=True)
        active = np.flatnonzero(count[back] > 1)
        if not len(active):
            break
        here = known[active]
        ahead = np.minimum(here + width, total)
        follow = np.where(text[np.minimum(ahead, total - 1)] == text[here], place[ahead], -1)
        rank = rank.copy()
        rank[active] = _groups([rank[active], follow], rank[active])
        width *= 2
    ranks = levels[-1][1][spots]
    order = np.argsort(ranks)
    out = spots[order]
    a, b = out[:-1], out[1:]
    same = np.zeros(len(a), np.int64)
    for width, place in reversed(levels):
        x, y = np.minimum(a + same, total), np.minimum(b + same, total)
        same += np.where((place[x] >= 0) & (place[x] == place[y]), width, 0)
    for _ in range(SEED_LCP - 1):  # fewer than SEED_LCP words are left to compare
        x, y = np.minimum(a + same, total - 1), np.minimum(b + same, total - 1)
        same += (a + same < total) & (b + same < total) & (words[x] == words[y]) & (text[x] == text[a]) & (text[y] == text[b])
    lcp = np.zeros(len(spots), np.int64)
    lcp[1:] = np.where((same >= SEED_LCP) & (text[a] == text[b]), same, 0)
    return out, lcp


def seeds(spots: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, distance, LCP) of positions that become neighbours with a distance of at most a third of the LCP."""
    parent = list(range(len(spots)))
    sets = [[p] for p in spots.tolist()]
    joins = np.flatnonzero(lcp)
    joins = joins[np.argsort(-lcp[joins], kind="stable")]
    found = []
    for i, level in zip(joins.tolist(), lcp[joins].tolist()):
        a, b = i - 1, i
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        big, small = (a, b) if len(sets[a]) >= len(sets[b]) else (b, a)
        host, guests = sets[big], sets[small]
        parent[small], sets[small] = big, []
        reach = level // (PERIODS - 1)
        at = 0
        for k, x in enumerate(guests):
            at = bisect_left(host, x, at)
            # The guest before x lies at `at - 1` if no host member stands between them.
            if at and (not k or host[at - 1] != guests[k - 1]) and x - host[at - 1] <= reach:
                found.append((host[at - 1], x - host[at - 1], level))
            if at < len(host) and (k + 1 == len(guests) or host[at] < guests[k + 1]) and host[at] - x <= reach:
                found.append((x, host[at] - x, level))
            host.insert(at, x)
            at += 1
    return found


def find_runs(words: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run with length >= max(6, 4 periods), by start, then period.

    `words` numbers the words of several texts one after another, `text` the text of each word. A run counts
    with its smallest period only.
    """
    spots = repeated_seeds(words, text)
    if not len(spots):
        return []
    out = set()
    for p, q, level in seeds(*suffix_order(words, text, spots)):
        left = p and text[p - 1] == text[p] and words[p - 1] == words[p - 1 + q]
        if not left and level + q >= max(LEAST, PERIODS * q):
            out.add((p, level + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _top(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for s, n, q in runs:  # by start, then period: the first of equals stays
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


def _digest(found: list[list[bytes]], plain: list[list[tuple[int, int, int]]]) -> list[tuple]:
    out = []
    for words, runs in zip(found, plain):
        keep = np.ones(len(words), bool)
        for s, n, q in runs:
            keep[s + q : s + n] = False
        best = _top(runs)
        left = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out.append((len(runs), *top, sha256(lines.encode()).hexdigest(), sha256(b" ".join(left)).hexdigest(), runs))
    return out


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, batch_words: int = BATCH_WORDS) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs: one row per document.

    The four fields of the run with the greatest length / period (ties: smallest start, then period) are null
    without a run; `runs` lists all as (start, length, period). Null and empty texts have no words, no run and the
    digest of the empty text. `plant` replaces the end of every tenth text by copies of its beginning (see
    `planted`; a null id is never planted). Rows stay rows, repeated ids too; other columns are ignored; an empty
    table stays empty. A text is read whole into one task; texts are taken in batches of about `batch_words` words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        if plant:
            for k, (i, words) in enumerate(zip(ids, texts)):
                if spot := planted(i, len(words)):
                    a, p = spot
                    texts[k] = words[:a] + (words[a : a + p] * (-(-(len(words) - a) // p)))[: len(words) - a]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        coded = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
        per: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        first = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(texts)), sizes)
        for s, n, q in find_runs(coded, which):
            per[which[s]].append((s - int(first[which[s]]), n, q))
        done = _digest(texts, per)
        columns = [pa.array(ids, pa.int64()), *[pa.array([d[k] for d in done], pa.int64()) for k in range(5)], *[pa.array([d[k] for d in done], pa.string()) for k in (5, 6)]]
        columns.append(pa.array([[{"start": s, "length": n, "period": q} for s, n, q in d[7]] for d in done], kind))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = split_words(t.as_py())
                ids.append(i)
                texts.append(words)
                held += len(words)
                if held >= batch_words:
                    yield work(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield work(ids, texts)

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>"
    return rows.mapInArrow(thrifty(run), schema)
