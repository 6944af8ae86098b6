"""Approximate nearest neighbours by largest inner product, from balanced posting lists.

Vectors get one more coordinate so that all have the same length; nearest by distance is then largest by
inner product. Centroids are fitted on a bounded sample with a penalty on full clusters. A vector near a
boundary goes into several lists. Queries find centroids by a best-first search of an in-memory neighbour
graph, and read the lists whose distance is within a ratio of the nearest one's. An exact check follows: a
list not read yet is read if its centroid and radius allow a score as large as the k-th one found, so no
neighbour is missed whatever the vectors are. Near lists form bands; bands and the queries that read them
meet in one shuffle, in parts and slices of bounded size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.session import land

SAMPLE_ROWS = 32_768
LIST_ROWS = 200
MAX_LISTS = 2048
GROUP_BYTES = 48 << 20  # vectors of one side that meet in one group
BLOCK_ROWS = 8192  # and of these, vectors that are scored at once
REPLICAS = 4
BOUNDARY = 1.03
RATIO = 1.25
BANDS = 32  # groups of near lists that meet the queries together
BEAM = 32


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0.0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k-means in which a cluster's surplus over the mean size counts as distance."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres, surplus = x[np.sort(rng.choice(len(x), k, replace=False))].copy(), np.zeros(k)
    for _ in range(rounds):
        d = _distances(x, centres)
        home = (d + surplus * d.min(1).mean()).argmin(1)
        size = np.bincount(home, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        full = size > 0
        centres[full] = sums[full] / size[full, None]
        surplus = 0.5 * surplus + 0.1 * (size / max(1.0, len(x) / k) - 1)
    return centres


class CentroidGraph:
    """Each centroid and its nearest ones; searched from a few entry points, best first."""

    def __init__(self, centres: np.ndarray, degree: int = 24):
        self.centres = centres
        self.links = np.argsort(_distances(centres, centres), axis=1, kind="stable")[:, 1 : degree + 1]
        self.entries = np.linspace(0, len(centres) - 1, min(8, len(centres))).astype(int)

    def search(self, q: np.ndarray, beam: int) -> list[tuple[float, int]]:
        """About the `beam` nearest centroids as (distance, number), nearest first."""
        def far(which):
            d = self.centres[which] - q
            return np.sqrt((d * d).sum(1))

        seen = np.zeros(len(self.centres), bool)
        seen[self.entries] = True
        todo = [(d, int(i)) for d, i in zip(far(self.entries), self.entries)]
        kept = [(-d, i) for d, i in todo]
        heapq.heapify(todo)
        heapq.heapify(kept)
        while todo:
            d, i = heapq.heappop(todo)
            if len(kept) >= beam and d > -kept[0][0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            for e, j in zip(far(new), new):
                if len(kept) < beam or e < -kept[0][0]:
                    heapq.heappush(todo, (e, int(j)))
                    heapq.heappush(kept, (-e, int(j)))
                    if len(kept) > beam:
                        heapq.heappop(kept)
        return sorted((-d, i) for d, i in kept)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, norm) of rows with an id and a non-zero vector of finite numbers, each pair once."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine).distinct().withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def best_of(ids: np.ndarray, lists: np.ndarray, v: np.ndarray, asked: np.ndarray, wanted: list, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score): each query's k best ids in the lists it wants, with scores of at least `least`.

    A fast product leaves out what cannot be among the k best, a plain one gives the scores: equal vectors
    must score equally, wherever they stand.
    """
    names, place = np.unique(lists, return_inverse=True)
    wants = np.array([np.isin(names, w) for w in wanted])
    deep = k * np.unique(ids, return_counts=True)[1].max()  # an id may stand in several lists
    slack = 1e-10 * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max())
    top = np.full((len(q), deep), -np.inf)
    rows, cols = [], []
    for at in range(0, len(v), BLOCK_ROWS):
        part = slice(at, at + BLOCK_ROWS)
        s = q @ v[part].T
        s[~wants[:, place[part]] | (ids[part] == asked[:, None])] = -np.inf
        both = np.hstack([top, s])
        top = np.partition(both, both.shape[1] - deep, axis=1)[:, -deep:]
        row, col = np.nonzero(s >= (np.maximum(least, top.min(1)) - slack)[:, None])
        real = s[row, col] > -np.inf
        rows.append(row[real])
        cols.append(col[real] + at)
    row, col = np.concatenate(rows), np.concatenate(cols)
    score = np.einsum("nd,nd->n", q[row], v[col])
    order = np.lexsort((ids[col], -score, row))
    row, got, score = row[order], ids[col][order], score[order]
    first = np.zeros(len(row), bool)
    first[np.unique(np.stack([row, got]), axis=1, return_index=True)[1]] = True  # the best of an id
    row, got, score = row[first], got[first], score[first]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], got[keep], score[keep]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", ratio: float = RATIO, beam: int = BEAM, boundary: float = BOUNDARY, list_rows: int = LIST_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products, itself left out, ties to the smaller id.

    Scores are in double precision on the vectors as given. Rows without an id, and null, zero or non-finite
    vectors take no part; neither do vectors of another length than the most frequent one. Equal rows count
    once. Other columns are ignored. An empty side gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = land(usable(vectors, id_col, vec_col), "vectors")
    widths = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = widths[0]["w"]
    group_rows = max(1, GROUP_BYTES // (8 * width))
    rows = rows.filter(F.size("vec") == width)
    n, longest = rows.agg(F.count("*"), F.max("norm")).first()
    asked = usable(queries, id_col, vec_col).filter(F.size("vec") == width).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), "norm")
    share = min(1.0, sample_rows / n)
    draw = F.pmod(F.xxhash64("vec_id", F.lit("lists")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(draw < share).orderBy("vec_id").select("vec", "norm").toPandas()  # about sample_rows rows
    if not len(sample):
        sample = rows.orderBy("vec_id").limit(1).select("vec", "norm").toPandas()
    x = np.array(sample["vec"].tolist(), float)
    x = np.hstack([x, np.sqrt(np.maximum(longest**2 - sample["norm"].to_numpy() ** 2, 0.0))[:, None]])
    centres = balanced_centroids(x, max(1, min(MAX_LISTS, n // list_rows)))
    band_of = _distances(centres, balanced_centroids(centres, BANDS)).argmin(1)

    def assign(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                p = b.slice(at, 2000)
                v = _matrix(p.column(1), width)
                norm = p.column(2).to_numpy()
                full = np.hstack([v, np.sqrt(np.maximum(longest**2 - norm**2, 0.0))[:, None]])
                d = np.sqrt(_distances(full, centres))
                top = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
                near = np.take_along_axis(d, top, 1)
                row, col = np.nonzero(near <= near[:, :1] * boundary + 1e-12)
                lists = top[row, col]
                off = v[row] - centres[lists, :-1]
                home = col == 0  # the check is about each vector's first list only
                reach = np.where(home, np.sqrt((off * off).sum(1)), -np.inf)
                long = np.where(home, norm[row], -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), pa.array(band_of[lists], pa.int64()), p.column(0).take(pa.array(row)), p.column(1).take(pa.array(row)), pa.array(reach), pa.array(long)], names=["list", "band", "vec_id", "vec", "reach", "norm"])

    posts = land(rows.select("vec_id", "vec", "norm").mapInArrow(assign, "list long, band long, vec_id long, vec array<double>, reach double, norm double"), "postings")
    reach, tallest, held_in = np.full(len(centres), -np.inf), np.full(len(centres), -np.inf), np.zeros(BANDS)
    for r in posts.groupBy("list", "band").agg(F.count("*").alias("held"), F.max("reach").alias("reach"), F.max("norm").alias("norm")).toLocalIterator():  # one row a list
        reach[r["list"]], tallest[r["list"]] = r["reach"], r["norm"]
        held_in[r["band"]] += r["held"]
    parts_of = np.ceil(held_in / group_rows).astype(int)
    parts = F.element_at(F.array(*[F.lit(max(1, int(m))) for m in parts_of]), (F.col("band") + 1).cast("int"))

    def search(batches):
        """The lists that the graph and the ratio give each query."""
        graph = CentroidGraph(centres)
        for b in batches:
            lists = []
            for q, norm in zip(_matrix(b.column(1), width), b.column(2).to_numpy()):
                found = graph.search(np.append(q * (longest / norm), 0.0), beam)
                lists.append([i for d, i in found if d <= found[0][0] * ratio + 1e-12])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int64()))], names=["query_id", "query", "norm", "lists"])

    def check(batches):
        """The lists not read yet that may hold a score of at least `least`."""
        for b in batches:
            lists, least = [], b.column(4).to_numpy()
            for at in range(0, b.num_rows, 2000):
                p = b.slice(at, 2000)
                norm = p.column(2).to_numpy()[:, None]
                most = np.minimum(_matrix(p.column(1), width) @ centres[:, :-1].T + norm * reach, norm * tallest)
                may = (most >= least[at : at + 2000, None] - 1e-10 * norm * longest) & (tallest > -np.inf)
                for row, done in zip(may, p.column(3).to_pylist()):
                    row[done] = False
                    lists.append(np.flatnonzero(row).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(lists, pa.list_(pa.int64())), b.column(4)], names=["query_id", "query", "norm", "lists", "least"])

    def bands(batches):
        """A row for each band that a query meets, with the lists it wants there."""
        for b in batches:
            row, band, lists = [], [], []
            for r, wanted in enumerate(b.column(2).to_pylist()):
                wanted = np.array(wanted, int)
                for i in np.unique(band_of[wanted]):
                    row.append(r)
                    band.append(int(i))
                    lists.append(wanted[band_of[wanted] == i].tolist())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(band, pa.int64()), b.column(0).take(take), b.column(1).take(take), pa.array(lists, pa.list_(pa.int64())), b.column(3).take(take)], names=["band", "query_id", "query", "lists", "least"])

    def meet(asks: pa.Table, held: pa.Table) -> pa.Table:
        out = [[np.array([], np.int64)], [np.array([], np.int64)], [np.array([], float)]]
        if asks.num_rows and held.num_rows:
            ids, lists, v = held.column("vec_id").to_numpy(), held.column("list").to_numpy(), _matrix(held.column("vec").combine_chunks(), width)
            for at in range(0, asks.num_rows, 512):
                p = asks.slice(at, 512)
                names = p.column("query_id").to_numpy()
                row, got, score = best_of(ids, lists, v, names, p.column("lists").to_pylist(), _matrix(p.column("query").combine_chunks(), width), p.column("least").to_numpy(), k)
                for column, more in zip(out, (names[row], got, score)):
                    column.append(more)
        return pa.table({name: np.concatenate(column) for name, column in zip(("query_id", "vec_id", "score"), out)})

    slices = -(-asked.count() // group_rows) or 1
    posts = posts.select("band", "list", "vec_id", "vec", F.pmod(F.xxhash64("vec_id"), parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def ask(some: DataFrame) -> DataFrame:
        routed = some.select("query_id", "query", "lists", "least").mapInArrow(bands, "band long, query_id long, query array<double>, lists array<long>, least double")
        routed = routed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("slice"))
        return routed.groupBy("band", "part", "slice").cogroup(posts.groupBy("band", "part", "slice")).applyInArrow(meet, schema)

    def leading(found: DataFrame, name: str) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return land(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), name)

    asked = land(asked.mapInArrow(search, "query_id long, query array<double>, norm double, lists array<long>"), "queries")
    found = leading(ask(asked.withColumn("least", F.lit(float("-inf")))), "neighbours")
    kth = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    left = asked.join(kth, "query_id", "left").select("query_id", "query", "norm", "lists", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    left = left.mapInArrow(check, "query_id long, query array<double>, norm double, lists array<long>, least double").filter(F.size("lists") > 0)
    found = leading(found.drop("rank").unionByName(ask(left)), "checked_neighbours")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
