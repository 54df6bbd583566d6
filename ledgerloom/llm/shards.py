"""Balanced shards by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import new_stage

SHARDS = 16
LARGE_PARTS = 1024
LEVELS = 20
BUNDLES = 32
SLOT_ROWS = 100_000


@dataclass
class _Node:
    room: int
    bin: int
    left: _Node | None = None
    right: _Node | None = None
    height: int = 1


class RoomTree:
    """Balanced (AVL) search tree of open bins by remaining room, then number."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    @staticmethod
    def _h(n: _Node | None) -> int:
        return n.height if n else 0

    def _fix(self, n: _Node) -> _Node:
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        lean = self._h(n.left) - self._h(n.right)
        if lean > 1:
            if self._h(n.left.left) < self._h(n.left.right):
                n.left = self._turn_left(n.left)
            return self._turn_right(n)
        if lean < -1:
            if self._h(n.right.right) < self._h(n.right.left):
                n.right = self._turn_right(n.right)
            return self._turn_left(n)
        return n

    def _turn_left(self, n: _Node) -> _Node:
        up = n.right
        n.right, up.left = up.left, n
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        up.height = 1 + max(self._h(up.left), self._h(up.right))
        return up

    def _turn_right(self, n: _Node) -> _Node:
        up = n.left
        n.left, up.right = up.right, n
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        up.height = 1 + max(self._h(up.left), self._h(up.right))
        return up

    def add(self, room: int, bin_: int) -> None:
        def into(n: _Node | None) -> _Node:
            if n is None:
                return _Node(room, bin_)
            if (room, bin_) < (n.room, n.bin):
                n.left = into(n.left)
            else:
                n.right = into(n.right)
            return self._fix(n)

        self.root = into(self.root)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (room, bin) of the smallest room of at least ``size``."""
        n, best = self.root, None
        while n:
            if n.room >= size:
                best, n = n, n.left
            else:
                n = n.right
        if best is None:
            return None
        found = (best.room, best.bin)

        def without(n: _Node, key: tuple[int, int]) -> _Node | None:
            if key < (n.room, n.bin):
                n.left = without(n.left, key)
            elif key > (n.room, n.bin):
                n.right = without(n.right, key)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                low = n.right
                while low.left:
                    low = low.left
                n.room, n.bin = low.room, low.bin
                n.right = without(n.right, (low.room, low.bin))
            return self._fix(n)

        self.root = without(self.root, found)
        return found


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size; sizes above ``capacity`` get a bin of their own."""
    tree, bins, where = RoomTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take_tightest(sizes[i])
        if found is None:
            found, bins = (max(capacity, sizes[i]), bins), bins + 1
        where[i] = found[1]
        tree.add(found[0] - sizes[i], found[1])
    return where


def smallest_capacity(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The least capacity found for which best-fit decreasing needs at most ``shards`` bins."""
    low, high = max(max(sizes, default=1), -(-sum(sizes) // shards)), max(1, sum(sizes))
    best = best_fit_decreasing(sizes, high)
    while low < high:
        middle = (low + high) // 2
        where = best_fit_decreasing(sizes, middle)
        if max(where, default=0) < shards:
            high, best = middle, where
        else:
            low = middle + 1
    return high, best


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, capacity: int | None = None, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row; equal texts share a shard.

    Size: UTF-8 bytes of the text plus one; a null text has one byte and forms a group
    with the other null texts, apart from empty ones. With ``capacity`` the number of
    shards is minimised; without it the capacity is, for ``shards`` shards, so sizes come
    out near equal unless one group alone exceeds its share. Slots number a shard's rows
    from 0. Repeated rows and null ids are kept; an empty table gives no rows.

    Groups of at least 1/1024 of a shard are packed one by one: there are at most
    1024 * shards of them. Smaller groups are packed as bundles chosen by a hash of the
    text, equally many of each share 1/2, 1/4, 1/8, ... of the whole, so ever finer bundles
    fill the last room: ``BUNDLES`` for up to 16 shards and more in proportion, so that
    the largest bundles have about a quarter of a shard. Only these two lists, which
    follow the number of shards, reach the driver.
    """
    spark = docs.sparkSession
    i, t = F.col(f"`{id_column}`"), F.col(f"`{text}`")
    digest = F.unhex(F.sha2(F.coalesce(t, F.lit("")).cast("binary"), 256))
    key = F.when(t.isNull(), F.lit(b"null")).otherwise(digest)
    rows, _ = new_stage(
        docs.select(
            i.alias("doc_id"),
            (F.octet_length(F.coalesce(t, F.lit(""))).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
            key.alias("__key"),
        ),
        "sizes",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = rows.groupBy("__key").agg(F.sum("size").alias("bytes"))
    share = max(1, capacity or -(-total // shards))
    limit = max(1, share // LARGE_PARTS)
    width = BUNDLES * max(1, -(-total // (16 * share)))
    large = groups.filter(F.col("bytes") >= limit).collect()  # at most total / limit rows
    # The level has half the mass of the one before it; the rest of the hash picks a bundle.
    h = F.xxhash64("__key")
    level = F.least(F.length(F.bin(F.shiftrightunsigned(h, 64 - LEVELS))), F.lit(LEVELS)).cast("long")
    bundle = (level * width + F.pmod(h, F.lit(width))).alias("__bundle")
    marked = spark.createDataFrame(
        [(bytes(r["__key"]), n) for n, r in enumerate(large)], "__large_key binary, __large int"
    )
    split = rows.withColumn("__bundle", bundle).join(
        F.broadcast(marked), F.col("__key") == F.col("__large_key"), "left"
    )  # at most 1024 * shards rows of 36 bytes
    bundles = split.filter("__large IS NULL").groupBy("__bundle").agg(F.sum("size").alias("bytes")).collect()
    bundles.sort(key=lambda r: r["__bundle"])
    sizes = [r.bytes for r in large] + [r.bytes for r in bundles]
    where = best_fit_decreasing(sizes, capacity) if capacity else smallest_capacity(sizes, shards)[1]
    items = [(f"g{n}", where[n]) for n in range(len(large))]
    items += [(f"b{r['__bundle']}", where[len(large) + n]) for n, r in enumerate(bundles)]
    item = F.coalesce(F.concat(F.lit("g"), "__large"), F.concat(F.lit("b"), "__bundle"))
    placed = split.withColumn("__item", item).join(
        F.broadcast(spark.createDataFrame(items, "__item string, shard int")), "__item"
    )  # the two bounded lists again
    return number_slots(spark, placed.select("doc_id", "size", "text_crc32", "shard"))


def number_slots(spark: SparkSession, placed: DataFrame) -> DataFrame:
    """Adds ``slot``: a shard's rows, numbered from 0 without gaps.

    Rows are numbered inside blocks of a shard and shifted by the rows of its earlier
    blocks, so no task holds a whole shard.
    """
    placed, _ = new_stage(placed.withColumn("__row", F.monotonically_increasing_id()), "placed")
    count = placed.count()
    blocks = max(1, -(-count // SLOT_ROWS)) * 16
    block = F.pmod(F.xxhash64("__row"), F.lit(blocks)).cast("int").alias("__block")
    cut = placed.select("*", block)
    sizes = cut.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("shard", "__block").orderBy("__row")
    numbered = cut.withColumn("__k", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "__block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("__k") + F.col("__before")).alias("slot")
    )
