"""Benchmark decontamination: test items contained in documents.

Items are partitioned by their number of five-word shingles. Each partition has its own
table and sketch size: the smallest hashes (a bottom-k MinHash) of more shingles than an
item of the partition may miss at the threshold; a document meets only the partitions whose
items fit into it. A document that contains enough of an item
therefore holds a sketched shingle; those candidates are verified by exact containment.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Words, mix, split_words

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BLOCK_BYTES = 32 << 20
_FILTER_BITS = 20


def sketch_size(most_shingles: int, threshold: float) -> int:
    """Shingles of which a document at the threshold must hold one."""
    return int(np.floor(most_shingles * (1 - threshold) + 1e-9)) + 1


def size_class(shingles: int) -> tuple[int, int, int]:
    """Partition of a shingle count: a power of two, and the least and largest count in it."""
    n = max(1, shingles).bit_length() - 1
    return n, 1 << n, (2 << n) - 1


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = mix(total * np.uint64(31) + hashes[k : len(hashes) - n + 1 + k] + np.uint64(k + 1))
    return total


class _Partition:
    """Sketches of the items of one size class and word run: hash -> items, behind a bit table."""

    def __init__(self, sketched: dict[int, list[int]], least: int) -> None:
        self.sketched, self.least = sketched, least
        self.keys = np.sort(np.fromiter(sketched, np.uint64, len(sketched)))
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def probe(self, grams: np.ndarray) -> set[int]:
        found: set[int] = set()
        grams = grams[self.bits[grams >> np.uint64(64 - _FILTER_BITS)]]
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        for h in np.unique(grams[self.keys[at] == grams]).tolist():
            found.update(self.sketched[h])
        return found


class _Items:
    """Size partitions with their own sketch tables, and exact shingles, of a bounded block of items."""

    def __init__(self, ids: list[list[int]], texts: list[str | None], threshold: float, shingle_words: int) -> None:
        self.threshold, self.shingle_words = threshold, shingle_words
        words = split_words(texts)
        hashes = words.hashes()
        sketched: dict[tuple[int, int, int], dict[int, list[int]]] = {}
        self.ids, self.shingles, self.length = [], [], []
        for d, i in enumerate(ids):
            a, e = int(words.first[d]), int(words.first[d + 1])
            if a == e:
                continue
            n = min(shingle_words, e - a)
            own = hashes[a:e]
            grams = np.unique(_grams(own, n))
            at = len(self.ids)
            self.ids.append(i)
            self.length.append(n)
            self.shingles.append(_spelled(words, a, e, n))
            part, least, most = size_class(len(grams))
            table = sketched.setdefault((n, part, least), {})
            for h in grams[: sketch_size(most, threshold)].tolist():
                table.setdefault(h, []).append(at)
        self.partitions: dict[int, list[_Partition]] = {}
        for (n, _, least), table in sorted(sketched.items()):
            # A document at the threshold has at least this many shingles itself.
            needed = int(np.ceil(threshold * least - 1e-9))
            self.partitions.setdefault(n, []).append(_Partition(table, needed))

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items that may be in a document; partitions of items too large for it are not probed."""
        found: set[int] = set()
        for n, parts in self.partitions.items():
            grams = _grams(hashes, n)
            for part in parts:
                if len(grams) < part.least:
                    break  # partitions rise in size
                found |= part.probe(grams)
        return found

    def contained(self, words: Words, hashes: np.ndarray, a: int, e: int) -> Iterator[tuple[int, float]]:
        """(item, containment) of each item at the threshold in the document of words a..e."""
        spelled: dict[int, set[bytes]] = {}
        for at in sorted(self.candidates(hashes[a:e])):
            n = self.length[at]
            if n not in spelled:
                spelled[n] = _spelled(words, a, e, n)
            own = self.shingles[at]
            share = len(own & spelled[n]) / len(own)
            if share >= self.threshold:
                yield at, share


def _spelled(words, a: int, e: int, n: int) -> set[bytes]:
    """Exact shingles of words a..e."""
    raw = words.data
    spelled = [raw[s:t].tobytes() for s, t in zip(words.start[a:e].tolist(), words.end[a:e].tolist(), strict=True)]
    return {b" ".join(spelled[i : i + n]) for i in range(len(spelled) - n + 1)}


def _blocks(items: DataFrame, threshold: float, shingle_words: int, item_id: str, item_text: str) -> Iterator[_Items]:
    """The items' text classes in blocks of about ``BLOCK_BYTES``."""
    classes = (
        items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t"))
        .filter(F.col("t").isNotNull())
        .groupBy("t")
        .agg(F.sort_array(F.collect_set("i")).alias("i"))
    )
    size = classes.agg(F.coalesce(F.sum(F.octet_length("t") + 8 * F.size("i")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for n in range(blocks):
        part = classes.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == n).collect()
        block = _Items([r.i for r in part], [r.t for r in part], threshold, shingle_words)
        if block.ids:
            yield block


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    shingle_words: int = SHINGLE_WORDS,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, containment, item_ids) of every item that a document contains.

    Words are runs of letters and digits, lower-cased; containment is the share of the
    item's distinct shingles that occur in the whole document. An item of fewer words is
    one shingle of all its words; one without words is contained nowhere. Items of equal
    text are one class under their smallest id; ``item_ids`` has all ids of the class (null
    ids are in none). Null texts contain nothing; null ids and
    repeated rows are reported as they are. An empty table gives no rows.

    Documents are scanned once per block of items; blocks hold about ``BLOCK_BYTES`` of
    item text each, which bounds what is broadcast. Nothing is shuffled but the items.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"))
    schema = "doc_id long, item_id long, containment double, item_ids array<long>"
    out = None
    for block in _blocks(items, threshold, shingle_words, item_id, item_text):
        found = rows.mapInArrow(_scan(spark.sparkContext.broadcast(block)), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _scan(block):
    def run(batches):
        items = block.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = part.column(0).to_pylist()
                words = split_words(part.column(1).to_pylist())
                hashes = words.hashes()
                out = []
                for d, doc in enumerate(ids):
                    a, e = int(words.first[d]), int(words.first[d + 1])
                    out += [(doc, next(iter(items.ids[at]), None), share, items.ids[at]) for at, share in items.contained(words, hashes, a, e)]
                if out:
                    d, i_, c, all_ = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, pa.int64()), pa.array(i_, pa.int64()), pa.array(c), pa.array(all_, pa.list_(pa.int64()))],
                        names=["doc_id", "item_id", "containment", "item_ids"],
                    )

    return run


def _without(block, at: int):
    """Keeps the rows whose text contains no item of the block."""

    def run(batches):
        items = block.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                words = split_words(part.column(at).to_pylist())
                hashes = words.hashes()
                clean = []
                for a, e in itertools.pairwise(words.first.tolist()):
                    clean.append(next(items.contained(words, hashes, a, e), None) is None)
                yield part.filter(pa.array(clean, pa.bool_()))

    return run


def clean_documents(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    shingle_words: int = SHINGLE_WORDS,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they are.

    Rows are judged where they stand, so null and repeated ids make no difference.
    """
    context, at, out = docs.sparkSession.sparkContext, docs.columns.index(text), docs
    for block in _blocks(items, threshold, shingle_words, item_id, item_text):
        out = out.mapInArrow(_without(context.broadcast(block), at), docs.schema)
    return out
