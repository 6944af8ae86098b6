"""Toxicity by multiple-instance learning.

Only documents are labelled, but what offends is a sentence. A sentence scores p = sigmoid(b + sum of its
words' weights), a document 1 - prod(1 - p) (noisy-or), and the weights are fitted to the document labels
through that formula, so they fall on the sentences that explain the label. A word's weight is the sum of
those of the word and its first 4, 5 and 6 letters, which covers inflected and compound forms; a penalty
on absolute weights keeps few of them. The fit uses a bounded sample of labelled rows; scoring is a map.

The bias alone gives every sentence a small p, which would add up in long texts. A score counts only what a
sentence has beyond it, 1 - (1 - p) / (1 - sigmoid(b)), and a repeated sentence once.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import thrifty

SAMPLE_ROWS = 6000
BITS = 18
ONE_LABEL = 12.0  # bias of a model that knows one label only
# Sentence ends become line ends; other ASCII characters but letters and digits become spaces.
TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x0A if chr(c) in ".!?\n" else 0x20 for c in range(256))


def sentences(text: str | None) -> list[list[bytes]]:
    """The different lower-cased words of each sentence; a sentence without words is left out."""
    if not text:
        return []
    return [w for s in text.lower().encode("utf-8", "surrogatepass").translate(TABLE).split(b"\n") if (w := list(dict.fromkeys(s.split())))]


def features(word: bytes) -> list[int]:
    """Hashed word and its first 4, 5 and 6 letters (a shorter word is its own prefix)."""
    letters = word.decode("utf-8", "ignore")
    return [xxhash.xxh32_intdigest(word, 0) >> (32 - BITS), *(xxhash.xxh32_intdigest(letters[:n].encode(), n) >> (32 - BITS) for n in (4, 5, 6) if len(letters) >= n)]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(docs: Iterable[list[list[bytes]]], labels: np.ndarray, rounds: int = 150, penalty: float = 2e-4, step: float = 0.3, bias: float = -8.0, clean: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights by feature and the fixed sentence bias, by proximal Adagrad on the noisy-or likelihood.

    The bias says that a sentence without telling words is clean; clean documents share the weight `clean`.
    """
    vocabulary: dict[bytes, int] = {}
    held, sentence_size, doc_size = array("i"), array("i"), array("i")
    for d in docs:
        doc_size.append(len(d))
        for s in d:
            sentence_size.append(len(s))
            held.extend([vocabulary.setdefault(w, len(vocabulary)) for w in s])
    ids, sizes, labels = np.frombuffer(held, np.int32), np.frombuffer(doc_size, np.int32), np.asarray(labels, float)
    parts = np.full((len(vocabulary), 4), 1 << BITS, np.int32)  # the last place is never weighted
    for i, w in enumerate(vocabulary):
        f = features(w)
        parts[i, : len(f)] = f
    del vocabulary
    y, sizes = labels[sizes > 0], sizes[sizes > 0]
    weights = np.zeros((1 << BITS) + 1)
    if not len(y) or y.min() == y.max():
        return weights, -ONE_LABEL if not len(y) or y.max() == 0 else ONE_LABEL
    sentence_size = np.frombuffer(sentence_size, np.int32)
    s_start, d_start = np.cumsum(sentence_size, dtype=np.int64) - sentence_size, np.cumsum(sizes, dtype=np.int64) - sizes
    balance = np.where(y == 1, (1 - clean) / max(1, (y == 1).sum()), clean / max(1, (y == 0).sum()))
    grads = np.full(len(weights), 1e-12)
    for _ in range(rounds):
        p = np.clip(_sigmoid(bias + np.add.reduceat(weights[parts].sum(1)[ids], s_start)), 1e-12, 1 - 1e-9)
        none = np.add.reduceat(np.log1p(-p), d_start)
        doc = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        outer = balance * np.where(y == 1, -(1 - doc) / doc, 1.0)
        g = np.repeat(outer, sizes) * p
        word_grad = np.bincount(ids, np.repeat(g, sentence_size), len(parts))
        grad = np.bincount(parts.ravel(), np.repeat(word_grad, 4), len(weights))
        grad[-1] = 0.0
        grads += grad * grad
        rate = step / np.sqrt(grads)
        weights = weights - rate * grad
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * penalty, 0.0)
    return weights, float(bias)


def evidence(sums: np.ndarray, bias: float) -> np.ndarray:
    """Log of the share of 1 - p that a sentence's words take away; 0 for words that weigh nothing or less."""
    clean = lambda x: np.log1p(-np.clip(_sigmoid(x), 0.0, 1 - 1e-12))
    return np.minimum(clean(bias + sums) - clean(bias), 0.0)


def document_score(counted: list[list[bytes]], sums: np.ndarray, bias: float) -> float:
    """Noisy-or of the different sentences. A model of one label has no weights: its bias is the answer."""
    if abs(bias) == ONE_LABEL:
        return float(bias > 0 and len(counted) > 0)
    first = list({frozenset(s): i for i, s in enumerate(counted)}.values())
    return float(-np.expm1(evidence(sums[first], bias).sum())) if first else 0.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Model from at most about `sample_rows` labelled rows, drawn by a hash of the id, half of either label where there are enough.

    Rows whose id or label is null, or is on one side only, are not used. Without rows of both labels the
    model gives the one label it knows (0 if none).
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna().distinct()
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect() if r["y"] in (0, 1)}
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, min(1.0, sample_rows / 2 / max(1, counts.get(1, 0)))).when(F.col("y") == 0, min(1.0, sample_rows / 2 / max(1, counts.get(0, 0)))).otherwise(0.0)
    known = known.filter(draw < share)  # about sample_rows rows, so small enough to broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id").orderBy("id", F.xxhash64("text")).select("text", "y").collect()
    return fit((sentences(r["text"]) for r in rows), np.array([r["y"] for r in rows]))


def score(rows: DataFrame, text_col: str, model: tuple[np.ndarray, float], out: str = "score", spans: str | None = None) -> DataFrame:
    """`rows` with the probability in column `out`, and optionally offending sentences in column `spans`.

    Texts are read whole. Null texts and texts without words score 0. `spans` lists the numbers (from 0, over
    sentences with words) and scores of sentences that score 0.5 or more.
    """
    at, (weights, bias) = rows.columns.index(text_col), model
    used = np.flatnonzero(weights)
    sparse = dict(zip(used.tolist(), weights[used].tolist()))
    schema = rows.withColumn(out, F.lit(0.0)).schema
    if spans:
        schema = rows.withColumn(out, F.lit(0.0)).withColumn(spans, F.array(F.struct(F.lit(0).cast("long").alias("sentence"), F.lit(0.0).alias("score")))).schema

    class Known(dict):
        def __missing__(self, word):
            if len(self) > 200_000:
                self.clear()
            x = self[word] = sum(sparse.get(f, 0.0) for f in features(word))
            return x

    def run(batches):
        known = Known()
        for b in batches:
            scores, found = [], []
            for text in b.column(at).to_pylist():
                parts = sentences(text)
                sums = np.array([sum([known[w] for w in s]) for s in parts])
                p = np.clip(_sigmoid(bias + sums), 0.0, 1 - 1e-12)
                scores.append(document_score(parts, sums, bias))
                found.append([{"sentence": int(i), "score": float(p[i])} for i in np.flatnonzero(p >= 0.5)])
            arrays, names = [*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, out]
            if spans:
                arrays.append(pa.array(found, pa.list_(pa.struct([("sentence", pa.int64()), ("score", pa.float64())]))))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(thrifty(run), schema)
