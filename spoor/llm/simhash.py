"""SimHash near-dedup: 64-bit fingerprints linked where few bits differ.

Equal fingerprints collapse first. The 64 bits are cut into `m` blocks; fingerprints that differ in at
most `bits` bits agree on some `m - bits` of them, so every choice of `m - bits` blocks is a join key and
no link is missed. `m` grows with the number of fingerprints so that a key holds a few of them at any
scale. Inside a key, one search marks what is within `bits` of what it has reached and reports each set
as a star: links inside a key never become pairs. A key with more than TILE fingerprints is searched as
pairs of tiles. Stars are merged by connected components.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import thrifty
from spoor.llm.components import connected_components
from spoor.session import land

SEED = 42
TILE = 20_000


def fingerprint(text: str | None, k: int = 4) -> int:
    """Bit i is 1 if set in over half of the XXH64 of all k-word shingles, A-Z lower-cased; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, len(words)
    joined = b" ".join(words)
    if n <= k:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip((ends - lengths)[: n - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, n - k + 1)
    ones = np.zeros(64, np.int64)
    for part in np.split(hashes, range(1 << 16, len(hashes), 1 << 16)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def add_fingerprints(rows: DataFrame, text_col: str, out: str, k: int = 4) -> DataFrame:
    """`rows` with the fingerprint of `text_col` as a long (two's complement) in column `out`."""
    at = rows.columns.index(text_col)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, k) for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], names=[*b.schema.names, out])

    return rows.mapInArrow(thrifty(run), rows.withColumn(out, F.lit(0).cast("long")).schema)


def block_masks(n: int, bits: int) -> list[int]:
    """Masks of the join keys for `n` fingerprints: enough blocks that a key has 2 bits more than log2(n)."""
    need, m = log2(max(n, 2)) + 2, bits + 1
    while m < 16 and 64 * (m - bits) / m < need:
        m += 1
    edges = [round(64 * i / m) for i in range(m + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, m - bits)]


def stars(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(member, centre) for every set of fingerprints joined by steps of at most `bits` differing bits."""
    out, rest = [], np.unique(values).view(np.uint64)  # bits of a negative number count as those of its absolute value
    while len(rest) > 1:
        centre, rest = rest[0], rest[1:]
        todo = [centre]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                todo.extend(found)
                out.extend((f, int(centre.view(np.int64))) for f in found.view(np.int64).tolist())
    return out


def fingerprint_components(prints: DataFrame, bits: int = 4, tile: int = TILE) -> DataFrame:
    """(node, root) for the fingerprints (long column `fp`) that have a link to another fingerprint."""
    nodes = land(prints.select("fp").distinct(), "fingerprints")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = block_masks(nodes.count(), bits)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)]))
    rows = nodes.select("fp", keys.alias("k")).select("fp", "k.mask", "k.key")
    full = rows.groupBy("mask", "key").count().filter("count > 1")
    rows = rows.join(full, ["mask", "key"]).withColumn("tiles", F.ceil(F.col("count") / tile).cast("long"))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"))))
    groups = rows.select("mask", "key", "fp", pairs.alias("t")).groupBy("mask", "key", "t").agg(F.collect_list("fp").alias("fps"))

    def run(batches):
        for b in batches:
            found = [x for v in b.column(0) for x in stars(v.values.to_numpy(), bits)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return connected_components(groups.select("fps").mapInArrow(run, "a long, b long"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, bits: int = 4) -> DataFrame:
    """One row per input row: id, fp (long), fingerprint (16 hex digits), component_id (smallest id reachable).

    Texts of fewer than k words are one shingle; null texts and texts without words have fingerprint 0 and
    link like any other. Null ids get their component's smallest known id (null if it has none); repeated
    rows stay rows. Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = land(add_fingerprints(rows, "text", "fp", k).select("doc_id", "fp"), "simhash")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = fingerprint_components(prints, bits)
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = land(named, "simhash_roots")
    names = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = groups.join(names, "root").select("fp", "component_id")
    return prints.join(groups, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, bits: int = 4) -> DataFrame:
    """The rows of `docs` without near-copies: of each component the row with the smallest id stays.

    A null id counts as larger than any other; of rows with equal ids the one read first stays.
    """
    from spoor.llm.common import fresh

    rid, fp = fresh(docs, "row_key"), fresh(docs, "row_fingerprint")
    rows = land(add_fingerprints(docs.withColumn(rid, F.monotonically_increasing_id()), text_col, fp, k), "simhash_rows")
    prints = rows.select(F.col(fp).alias("fp"), F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col(rid).alias("r")).alias("row"))
    least = prints.groupBy("fp").agg(F.min("row").alias("row"))
    roots = fingerprint_components(prints, bits)
    kept = least.join(roots, least["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp")).agg(F.min("row").alias("row")).select(F.col("row.r").alias(rid))
    return rows.join(kept, rid, "left_semi").select(*docs.columns)
