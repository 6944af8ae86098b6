"""Benchmark decontamination: shared word sequences, then Smith-Waterman alignment.

All n-word sequences of the test items (seeds) are looked up in every document in one pass; documents with
a hit are kept aside. A document and an item are aligned around every seed they share, however frequent it
is, so an alignment with `least` of a full match that runs through a seed is always found. A region is left
out only if it has too few of the item's words to score that much. The alignment is local, over words, with
gaps, so edited, cut and paraphrased copies score by what they share.

Test items are processed in blocks of bounded size; only one block's items are in memory at a time.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import WordHash, fresh, thrifty
from spoor.session import land

MATCH, MISS, GAP = 2, 1, 1
BLOCK_WORDS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
CELLS = 1 << 21
# Letters, digits and all non-ASCII bytes stay; other ASCII characters separate words.
KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(KEEP).split() if text else []


def word_ids(words: list[bytes], seen: WordHash) -> np.ndarray:
    return np.fromiter((seen[w] for w in words), np.uint64, len(words))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = (out ^ ids[i : i + m]) * MIX
        out ^= out >> np.uint64(29)
    return out


def smith_waterman(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score and its last text column, for padded rows of word numbers (different negatives: padding)."""
    rows, width = texts.shape
    cost = np.arange(width) * GAP
    last, best, where = np.zeros((rows, width), np.int32), np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for i in range(items.shape[1]):
        diagonal = np.zeros((rows, width), np.int32)
        diagonal[:, 1:] = last[:, :-1]
        h = np.maximum(diagonal + np.where(items[:, i : i + 1] == texts, MATCH, -MISS), last - GAP)
        h = np.maximum(h, 0)
        last = np.maximum.accumulate(h + cost, axis=1) - cost
        top = last.max(axis=1)
        better = top > best
        best[better] = top[better]
        where[better] = last[better].argmax(axis=1)
    return best, where


def _align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, int, int]]:
    """Score (share of a full match), first and last word of the text, for each (item, text) of word ids."""
    out = [(0.0, 0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(order):
        count, m, w = 0, 0, 1
        while at + count < len(order):
            a, b = pairs[order[at + count]]
            m, wider = max(m, len(a)), max(w, len(b))
            if count and (count + 1) * wider > CELLS:
                break
            w, count = wider, count + 1
        batch = order[at : at + count]
        at += count
        left, right = np.full((count, m), -1, np.int64), np.full((count, w), -2, np.int64)
        for r, k in enumerate(batch):
            a, b = pairs[k]
            numbers = {x: j for j, x in enumerate(dict.fromkeys(a.tolist()))}
            left[r, : len(a)] = [numbers[x] for x in a.tolist()]
            right[r, : len(b)] = [numbers.get(x, -2) for x in b.tolist()]
        score, end = smith_waterman(left, right)
        flip_l, flip_r = np.full_like(left, -1), np.full_like(right, -2)
        for r, k in enumerate(batch):
            a, b = pairs[k]
            flip_l[r, : len(a)] = left[r, : len(a)][::-1]
            flip_r[r, : len(b)] = right[r, : len(b)][::-1]
        _, begin = smith_waterman(flip_l, flip_r)
        for r, k in enumerate(batch):
            a, b = pairs[k]
            first = len(b) - 1 - int(begin[r])
            out[k] = (float(score[r]) / (MATCH * len(a)), min(first, int(end[r])), int(end[r]))
    return out


def _hits(rows: DataFrame, text_col: str, seeds: np.ndarray, n: int) -> DataFrame:
    """Rows with a seed: row key, plain text, and positions and hashes of the seeds in it."""

    def run(batches):
        seen = WordHash()
        for b in batches:
            keys, texts, at, found = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = plain_words(text)
                g = grams(word_ids(words, seen), n)
                if len(g):
                    where = np.searchsorted(seeds, g)
                    hit = np.flatnonzero(seeds[np.minimum(where, len(seeds) - 1)] == g)
                    if len(hit):
                        keys.append(key)
                        texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                        at.append(hit.tolist())
                        found.append(g[hit].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(at, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))], names=["row_key", "words", "at", "seeds"])

    return rows.mapInArrow(thrifty(run), "row_key long, words string, at array<long>, seeds array<long>")


def _regions(diagonals: list[int], length: int, least: float) -> list[tuple[int, int]]:
    """Text ranges around the seeds; each holds all alignments through its seeds that have `least` of a full match.

    Such an alignment has at most MATCH * length * (1 - least) / GAP gaps, which shift it by as many words.
    """
    out, slack = [], length // 4 + 2
    reach = max(slack, math.ceil(MATCH * length * (1 - least) / GAP))
    diagonals = sorted(diagonals)
    start = 0
    for i in range(1, len(diagonals) + 1):
        if i == len(diagonals) or diagonals[i] - diagonals[i - 1] > slack:
            out.append((diagonals[start] - reach, diagonals[i - 1] + length + reach))
            start = i
    return out


def _shared(item: np.ndarray, text: np.ndarray) -> int:
    """How many words of the item a text can match at most: repeated words count as often as both have them."""
    (a, n), (b, m) = np.unique(item, return_counts=True), np.unique(text, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _aligned(hits: DataFrame, items: dict, places: dict, least: float) -> DataFrame:
    def run(batches):
        seen = WordHash()
        for b in batches:
            pairs, about = [], []
            for key, text, at, found in zip(*(b.column(i).to_pylist() for i in range(4))):
                near = defaultdict(list)
                for pos, seed in zip(at, found):
                    for item, place in places.get(seed, ()):
                        near[item].append(pos - place)
                if not near:
                    continue
                ids = word_ids(text.encode("utf-8", "surrogatepass").split(), seen)
                for item, diagonals in near.items():
                    for a, e in _regions(diagonals, len(items[item]), least):
                        a = max(a, 0)
                        if _shared(items[item], ids[a:e]) >= least * len(items[item]):
                            pairs.append((items[item], ids[a:e]))
                            about.append((key, item, a))
            best = {}
            for (key, item, a), (score, first, last) in zip(about, _align(pairs)):
                if score >= least and score > best.get((key, item), (0.0,))[0]:
                    best[key, item] = (score, a + first, a + last + 1)
            rows = [(*k, *v) for k, v in best.items()]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["row_key", "item_no", "score", "first_word", "end_word"])

    return hits.mapInArrow(thrifty(run), "row_key long, item_no long, score double, first_word long, end_word long")


def find_leaks(rows: DataFrame, benchmark: DataFrame, row_key: str, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 4, least: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row_key, item_id, score, first_word, end_word): documents that hold a test item or an edited copy of it.

    `score` is the local alignment's share of a full match of the item, at least `least`; word positions count
    words without punctuation. Copies that share no n words in a row with the item are not found. One row per document and item (of equal items, each is reported). `row_key`
    names a unique long. Null and empty texts match nothing, and neither do items of fewer than n words, which
    are too short to tell a leak from chance. Other columns are ignored; an empty side gives an empty result.
    """
    spark = rows.sparkSession
    tests = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    tests = land(tests.withColumn("item_no", F.xxhash64("item_id", "text")).dropDuplicates(["item_no"]), "benchmark")
    words = tests.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    docs = rows.select(F.col(row_key).cast("long").alias("row_key"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], "row_key long, item_no long, score double, first_word long, end_word long")
    for block in range(blocks):
        local = tests.filter(F.pmod(F.hash("item_no"), F.lit(blocks)) == block).collect()  # about block_words words
        seen = WordHash()
        items = {r["item_no"]: word_ids(plain_words(r["text"]), seen) for r in local}
        items = {k: v for k, v in items.items() if len(v) >= n}
        if not items:
            continue
        seeds = {k: grams(v, n).view(np.int64) for k, v in items.items()}
        every = np.unique(np.concatenate(list(seeds.values())).view(np.uint64))
        hits = land(_hits(docs, "text", every, n), "benchmark_hits")
        places = defaultdict(list)
        for item, s in seeds.items():
            for place, seed in enumerate(s.tolist()):
                places[seed].append((item, place))
        out = out.unionByName(_aligned(hits, items, dict(places), least))
    return out.join(tests.select("item_no", "item_id"), "item_no").select("row_key", "item_id", "score", "first_word", "end_word")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) for every contaminated row of `docs`; repeated rows repeat."""
    key = fresh(docs, "row_key")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = keyed.withColumn(key, F.xxhash64("text"))
    found = land(find_leaks(keyed, benchmark, key, "text", **how).distinct(), "leaks")
    return keyed.select("doc_id", F.col(key).alias("row_key")).join(found, "row_key").drop("row_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` that hold no test item and no edited copy of one."""
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    found = land(find_leaks(keyed, benchmark, key, text_col, **how).select(F.col("row_key").alias(key)).distinct(), "leaks")
    return keyed.join(found, key, "left_anti").select(*docs.columns)
