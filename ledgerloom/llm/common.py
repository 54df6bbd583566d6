"""What several corpus operators share: written stages, byte-level words, hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import remove_folder, shared_folder

__all__ = ["Words", "free_name", "labelled_sample", "merge_best", "new_stage", "remove_folder", "shared_folder", "split_words"]


def new_stage(df: DataFrame, purpose: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Writes ``df`` to a fresh folder all executors share and reads it back.

    The written table cuts the lineage: a lost executor re-reads files instead of
    repeating the stage. The folder is returned for its later removal.
    """
    where = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", compression).parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where), where


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def labelled_sample(spark: SparkSession, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(id, y) of about ``rows`` labelled documents, chosen by a hash of the id.

    One row per id (the largest label where an id repeats); rows without id or label
    are left out. With at most ``rows`` labels all are taken.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    total = known.count()
    if total <= rows:
        return known
    share = int(rows / total * (1 << 30))
    return known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)


MERGE_TASKS = 64


def merge_best(entries: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Ranks 1..k of each key's entries, merged in a tree.

    ``entries`` holds the best of each task; those of ``MERGE_TASKS`` tasks meet first, so
    that no key gathers the lists of all tasks at once.
    """
    near = entries.withColumn("__task", F.floor(F.spark_partition_id() / MERGE_TASKS))
    some = Window.partitionBy(*keys, "__task").orderBy(*order)
    near = near.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k).drop("__task", "rank")
    best = Window.partitionBy(*keys).orderBy(*order)
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


# Word bytes: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values; equal inputs stay equal."""
    x = (x ^ (x >> _SHIFT)) * _MULTIPLIER
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of a batch of texts as flat arrays.

    ``data`` holds the bytes of all texts; word ``i`` is ``data[start[i]:end[i]]``, and
    ``first[d]:first[d + 1]`` are the words of text ``d``.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> None:
        self.data, self.start, self.end, self.first = data, start, end, first

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: a polynomial over its bytes, from prefix sums."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        # Eight bytes at a time keep the powers short; longer words chain their parts.
        value = np.zeros(len(self.start), np.uint64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        at, length = self.start.copy(), self.end - self.start
        alive = np.arange(len(at))
        while len(alive):
            part = np.zeros(len(alive), np.uint64)
            left = length[alive]
            for k in range(8):
                byte = np.where(left > k, padded[at[alive] + k], 0).astype(np.uint64)
                part |= byte << np.uint64(8 * k)
            value[alive] = mix(value[alive] * np.uint64(31) + part + np.uint64(1))
            at[alive] += 8
            length[alive] -= 8
            at[alive] = np.minimum(at[alive], len(self.data))
            alive = alive[length[alive] > 0]
        return mix(value ^ (self.end - self.start).astype(np.uint64))


def split_words(texts: list[str | None]) -> Words:
    """Lower-cased words (runs of letters and digits) of each text."""
    encoded = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    # A separator after each text keeps words apart.
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    inside = WORD_BYTE[data]
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    bounds = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])]).astype(np.int64)
    first = np.searchsorted(start, bounds)
    return Words(data, start, end, first)
