"""Substring dedup: every window of W words that occurs more than once is cut out of all its places.

A window's Rabin-Karp hash is a polynomial of its words' 64-bit hashes modulo 2**64; all windows of a
text come from one running sum. Documents are dealt into chunks of bounded size. A chunk sends each of
its distinct hashes once, packed per hash bucket, so a passage that a third of all documents share
crosses the network once per chunk. The bucket answers each chunk with a bit per hash: met elsewhere or
not. The chunk, which Spark still holds from the one shuffle of the texts, derives the same hashes again,
marks the covered words and merges them into maximal intervals.

Windows are compared by 64 bits of one polynomial inside a bucket drawn from a second one, so two
different windows among n meet with a chance of about n**2 / (2 * buckets * 2**64).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import WordHash, buckets_for, split_words

# Two odd multipliers of the window polynomials, and one that spreads bucket numbers.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SPREAD = np.uint64(0xFF51AFD7ED558CCD)
CHUNK_ROWS = 1000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Windows:
    """Hash and bucket of every window of a list of texts, in order."""

    def __init__(self, window: int, buckets: int):
        self.window, self.buckets, self.words = window, buckets, WordHash()
        self.powers = [(np.ones(0, np.uint64), np.ones(0, np.uint64))] * 2

    def _poly(self, values: np.ndarray, which: int) -> np.ndarray:
        n = len(values)
        if len(self.powers[which][0]) < n:
            base = BASES[which]
            self.powers[which] = (_powers(base, 2 * n), _powers(pow(base, -1, 1 << 64), 2 * n))
        up, down = self.powers[which]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:n], dtype=np.uint64)])
        return (total[self.window :] - total[: -self.window]) * down[: n - self.window + 1]

    def of(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, buckets and the number of windows of each document."""
        tags, places, counts = [], [], []
        for words in docs:
            n = max(0, len(words) - self.window + 1)
            counts.append(n)
            if n:
                hashed = self.words
                values = np.fromiter((hashed[w] for w in words), np.uint64, len(words))
                tags.append(self._poly(values, 0))
                places.append(((self._poly(values, 1) * SPREAD) >> np.uint64(33)) % np.uint64(self.buckets))
        empty = np.zeros(0, np.uint64)
        return np.concatenate(tags or [empty]), np.concatenate(places or [empty]), np.array(counts, np.int64)

    def distinct(self, docs: list[list[bytes]]):
        """Distinct (bucket, hash) in order, which of them each window is, how often each occurs, windows per document."""
        tags, places, counts = self.of(docs)
        order = np.lexsort((tags, places))
        t, p = tags[order], places[order]
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1])
        which = np.empty(len(t), np.int64)
        which[order] = np.cumsum(first) - 1
        return t[first], p[first].astype(np.int64), which, np.bincount(which, minlength=int(first.sum())), counts


def _emit(window: int, buckets: int):
    def emit(table: pa.Table) -> pa.Table:
        w = Windows(window, buckets)
        tags, places, _, _, _ = w.distinct([split_words(t) for t in table.column("text").to_pylist()])
        used, start = np.unique(places, return_index=True)
        ends = np.append(start[1:], len(places))
        return pa.table({
            "bucket": pa.array(used, pa.int64()),
            "chunk": pa.array([table.column("chunk")[0].as_py()] * len(used), pa.int64()),
            "tags": pa.array([tags[a:b].tobytes() for a, b in zip(start, ends)], pa.binary()),
        })

    return emit


def _answer(table: pa.Table) -> pa.Table:
    """For each chunk that sent hashes to this bucket: a bit per hash, set if another chunk sent it too."""
    parts = [np.frombuffer(b, np.uint64) for b in table.column("tags").to_pylist()]
    sizes = np.array([len(p) for p in parts])
    tags = np.concatenate(parts)
    order = np.argsort(tags, kind="stable")
    same = tags[order][1:] == tags[order][:-1]
    met = np.zeros(len(tags), bool)
    met[order[1:][same]] = True
    met[order[:-1][same]] = True
    masks = np.split(met, np.cumsum(sizes)[:-1])
    rows = [(c, np.packbits(m).tobytes()) for c, m in zip(table.column("chunk").to_pylist(), masks) if m.any()]
    return pa.table({
        "chunk": pa.array([c for c, _ in rows], pa.int64()),
        "bucket": pa.array([table.column("bucket")[0].as_py()] * len(rows), pa.int64()),
        "mask": pa.array([m for _, m in rows], pa.binary()),
    })


def _cut(window: int, buckets: int, id_type: pa.DataType):
    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        w = Windows(window, buckets)
        texts = [split_words(t) for t in docs.column("text").to_pylist()]
        tags, places, which, times, counts = w.distinct(texts)
        repeated = times > 1
        for bucket, mask in zip(answers.column("bucket").to_pylist(), answers.column("mask").to_pylist()):
            a, b = np.searchsorted(places, [bucket, bucket + 1])
            repeated[a:b] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
        hit = repeated[which] if len(which) else np.zeros(0, bool)
        removed, kept, spans, at = [], [], [], 0
        for words, n in zip(texts, counts):
            edge = np.zeros(len(words) + 1, np.int64)
            starts = np.flatnonzero(hit[at : at + n])
            at += n
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            kept.append(b" ".join([x for x, g in zip(words, gone) if not g] if len(starts) else words))
            turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append(",".join(f"{a}:{b}" for a, b in turns.reshape(-1, 2)))
        return pa.table({
            "doc_id": docs.column("doc_id").cast(id_type),
            "n_words": pa.array([len(x) for x in texts], pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()),
            "removed_spans": pa.array(spans, pa.string()),
        })

    return cut


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, chunk_rows: int = CHUNK_ROWS, buckets: int | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (kept words, one space between) and removed_spans.

    `removed_spans` lists maximal intervals "from:to" of word positions (end exclusive), comma-joined.
    Null and empty texts, and texts shorter than the window, keep all they have (0 words removed). Null and
    repeated ids are ordinary rows; of repeated rows with `window` words or more each repeats the other.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    buckets = buckets or buckets_for(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = max(1, -(-docs.count() // chunk_rows))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long"))
    sent = rows.groupBy("chunk").applyInArrow(_emit(window, buckets), "bucket long, chunk long, tags binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, mask binary")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _cut(window, buckets, pa.int64()), "doc_id long, n_words long, n_removed long, kept_text string, removed_spans string"
    )
