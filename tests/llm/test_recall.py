"""Nearest vectors on rows whose lists mislead: clusters of very different lengths, and repeated vectors."""

from __future__ import annotations

import numpy as np

from spoor.llm import neighbours


def test_clusters_of_different_lengths(spark):
    rng = np.random.default_rng(3)
    n, d = 4000, 16
    centres = rng.normal(size=(40, d)) * np.exp(rng.normal(size=(40, 1)))
    x = centres[np.arange(n) % 40] + 0.2 * rng.normal(size=(n, d))
    x[1000:1100] = x[0]  # equal vectors: the smaller id first
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0"), k=20, list_rows=100).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(0, n, 20):
        s = np.einsum("nd,d->n", x, x[q])
        s[q] = -np.inf
        assert [got[q][r] for r in range(1, 21)] == np.lexsort((np.arange(n), -s))[:20].tolist()
