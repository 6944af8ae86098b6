"""Token ids in files of bit- or byte-planes.

Documents are range-partitioned by id and sorted; a task tokenises its range and packs it into segments of
whole documents. A segment is one binary record:

    magic "SPLN", version, plane kind, block size, number of ids, documents and blocks (little endian)
    document table: ids (with a null mask) and token counts, zstandard-compressed
    chunk index: number of ids and compressed length of each plane, for every block
    planes: a block's ids transposed into 4 byte planes or 32 bit planes, each zstandard-compressed

Segments are written as a Parquet table, so they land in any store that Spark writes, and are read back
one at a time without a shuffle. Id positions over all documents come from sums per segment and partition.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = struct.Struct("<4sBBIQII")
MAGIC, VERSION = b"SPLN", 1
BLOCK, SEGMENT = 1 << 16, 1 << 20
# Around a cut both neighbours are ordinary characters, so a space opens a new word for the tokenizer and a
# line end stands alone. \x01 marks words without a space before them.
UNUSUAL = r"\x01|^[ \n]|[ \n]$|[ \n][\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}][ \n]"
_LOADED: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """Ids of texts by a byte-level BPE tokenizer; each distinct space-led word is encoded once and remembered.

    Such a tokenizer never merges across a space or line end that stands between two other characters, so the
    ids of the pieces, joined, are those of the whole text. Texts with any other spacing are encoded whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.most, self.known, self.older = Tokenizer.from_file(path), most, {}, {}

    @classmethod
    def loaded(cls, path: str) -> PieceEncoder:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces, many to a call, with a line end between them that is one id of its own."""
        line = int(self.whole("\n")[0])
        self.known["\x01"], self.known["\n"] = b"", np.array([line], np.uint32).tobytes()
        bare = [p[1:] if p[0] == "\x01" else f" {p}" for p in pieces]
        for at in range(0, len(pieces), 4096):
            keys, part = pieces[at : at + 4096], bare[at : at + 4096]
            ids = self.whole("\n" + "\n".join(part))
            starts = np.flatnonzero(ids == line)
            if len(starts) == len(part):
                raw, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
                self.known.update((k, raw[a:e]) for k, a, e in zip(keys, (4 * starts + 4).tolist(), ends))
            else:
                self.known.update((k, self.whole(p).tobytes()) for k, p in zip(keys, part))

    def _recall(self, words: list[str]) -> list[bytes]:
        """Ids of every word as bytes. When memory is full, words not met since the time before are forgotten."""
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.most:
            self.older, self.known = known, {}
            known, new = self.known, words
        if self.older:
            known.update((w, self.older[w]) for w in new if w in self.older)
            new = [w for w in new if w not in known]
        self._learn([w for w in new if w not in ("\x01", "\n")])
        return [known[w] for w in words]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One id array per text; null is the empty text."""
        empty, mark = pa.scalar("", pa.large_string()), pa.scalar("\x01", pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), empty)
        odd = pc.match_substring_regex(texts, UNUSUAL).to_numpy(zero_copy_only=False)
        plain = pc.replace_substring(pc.if_else(pa.array(odd), empty, texts), "\n", " \n \x01")
        pieces = pc.split_pattern(pc.binary_join_element_wise(mark, plain, empty), " ")
        coded = pc.dictionary_encode(pieces.values)
        words = coded.dictionary.to_pylist()
        ids = self._recall(words)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(ids), np.uint32)
        which = coded.indices.to_numpy()
        n = lengths[which]
        ends = np.cumsum(n)
        picked = flat[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[pieces.offsets.to_numpy()]
        return [self.whole(t.as_py()) if o else picked[a:b] for t, o, a, b in zip(texts, odd, bounds, bounds[1:])]


def _planes(block: np.ndarray, bits: bool) -> list[bytes]:
    by = np.ascontiguousarray(block.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return [p.tobytes() for p in by]
    return [np.packbits((p >> i) & 1, bitorder="little").tobytes() for p in by for i in range(8)]


def _unplane(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if bits:
        flat = [np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes]
        planes = [sum((flat[8 * k + i] << i for i in range(8)), np.zeros(n, np.uint8)).tobytes() for k in range(4)]
    return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes]).T).reshape(-1).view("<u4")


def pack_segment(doc_ids: list[int | None], docs: list[np.ndarray], bits: bool = False, block: int = BLOCK, level: int = 3) -> bytes:
    """The binary record of whole documents."""
    z = zstandard.ZstdCompressor(level=level)
    ids = np.concatenate([np.zeros(0, np.uint32), *docs])
    table = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes() + np.array([len(d) for d in docs], "<u4").tobytes()
    table = z.compress(table)
    index, body = [], []
    for at in range(0, len(ids), block):
        part = [z.compress(p) for p in _planes(ids[at : at + block], bits)]
        index += [min(block, len(ids) - at), *map(len, part)]
        body += part
    blocks = -(-len(ids) // block)
    head = HEADER.pack(MAGIC, VERSION, bits, block, len(ids), len(docs), blocks)
    return b"".join([head, struct.pack("<I", len(table)), table, np.array(index, "<u4").tobytes(), *body])


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and all ids of a binary record."""
    z = zstandard.ZstdDecompressor()
    magic, version, bits, _, n_ids, n_docs, blocks = HEADER.unpack_from(data)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a token segment")
    (size,) = struct.unpack_from("<I", data, HEADER.size)
    at = HEADER.size + 4
    table = z.decompress(data[at : at + size])
    at += size
    keys, null, counts = np.frombuffer(table, "<i8", n_docs), np.frombuffer(table, np.uint8, n_docs, 8 * n_docs), np.frombuffer(table, "<u4", n_docs, 9 * n_docs)
    wide = 1 + (32 if bits else 4)
    index = np.frombuffer(data, "<u4", blocks * wide, at).reshape(blocks, wide)
    at += index.nbytes
    out = []
    for n, *sizes in index.tolist():
        planes = []
        for s in sizes:
            planes.append(z.decompress(data[at : at + s]))
            at += s
        out.append(_unplane(planes, n, bool(bits)))
    ids = np.concatenate([np.zeros(0, "<u4"), *out])
    if len(ids) != n_ids:
        raise ValueError("token segment is cut short")
    return [None if x else int(k) for k, x in zip(keys, null)], counts, ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, bits: bool = False, slice_rows: int = 2500) -> None:
    """Tokenise every text, append `end_id` to each and write segments in ascending id order below `path`.

    Null and empty texts have the end id alone. Null ids come first; rows with equal ids follow each other
    in the order of a hash of their text. Other columns are ignored. An empty table writes no segment.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        encoder = PieceEncoder.loaded(tokenizer)
        part, seq, keys, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            data = pack_segment(keys, held, bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_ids", "segment"])

        end = np.array([end_id], np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, slice_rows):
                piece = b.slice(at, slice_rows)
                for key, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1))):
                    keys.append(key)
                    held.append(np.concatenate([ids, end]))
                    size += len(held[-1])
                    if size >= SEGMENT:
                        yield flush()
                        seq, keys, held, size = seq + 1, [], [], 0
        if keys:
            yield flush()

    rows.mapInArrow(run, "part int, seq long, n_ids long, segment binary").write.parquet(path)


def _summaries(batches):
    for b in batches:
        for part, seq, data in zip(*(b.column(i).to_pylist() for i in range(3))):
            keys, counts, ids = unpack_segment(data)
            ends = np.cumsum(counts, dtype=np.int64)
            raw = ids.tobytes()
            crcs = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(ends - counts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(keys), pa.int32()), pa.array([seq] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())],
                names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_token_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it over all documents), n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    seen = files.select("part", "seq", "segment").mapInArrow(_summaries, "part int, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "seq", "n_ids")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("part_start", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)))  # one row per written partition
    offsets = sizes.withColumn("seq_start", F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("seq")), F.lit(0))).join(parts.drop("n"), "part")
    offsets = offsets.select("part", "seq", (F.col("seq_start") + F.col("part_start")).alias("first"))
    return seen.join(offsets, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its ids (with the end id), read back from the files."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                keys, counts, ids = unpack_segment(data)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], names=["doc_id", "ids"])

    return spark.read.parquet(path).select("segment").mapInArrow(run, "doc_id long, ids array<long>")
