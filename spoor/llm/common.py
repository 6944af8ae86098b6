"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def split_words(text: str | None) -> list[bytes]:
    """The maximal runs of characters other than space and \\x09-\\x0D, as UTF-8 (null: none)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHash(dict):
    """XXH64 of a word, remembered for the words met last; memory stays bounded."""

    def __init__(self, seed: int = 0, most: int = 200_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h


def buckets_for(df: DataFrame, times: int = 2, least: int = 64) -> int:
    """Key buckets in proportion to the session's shuffle partitions, which follow the data."""
    return max(least, times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def thrifty(run):
    """A function for mapInArrow that gives the memory of its task back to the system, as workers live on."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task
