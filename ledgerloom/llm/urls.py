"""URL rules: a blocked Bloom filter of listed keys in front of an exact hash join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
PROBES = 6
FILTER_BLOCKS = 1 << 20  # of 512 bits: the filter never passes 64 MB
SEGMENT_BLOCKS = 1 << 10


def _tail(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def url_host(url: Column) -> Column:
    """Between ``://`` and the first ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_tail(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end to the first ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(_tail(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


class BlockedBloom:
    """Bloom filter whose probes for one key lie in one 512-bit block.

    A key's block is given by the high half of its hash, so the blocks of a range hold the
    keys of a range, and a filter is put together from segments built apart.
    """

    def __init__(self, blocks: int, words: np.ndarray | None = None) -> None:
        self.mask = np.uint64(blocks - 1)
        self.words = np.zeros(blocks * 8, np.uint64) if words is None else words

    @staticmethod
    def blocks_for(keys: int) -> int:
        """A power of two: ``BITS_PER_KEY`` bits a key up to ``FILTER_BLOCKS``, fewer beyond.

        A fuller filter passes more keys on to the exact join, which changes no verdict.
        """
        return min(FILTER_BLOCKS, 1 << max(0, (max(1, keys) * BITS_PER_KEY - 1) // 512).bit_length())

    def add(self, hashes: np.ndarray) -> None:
        for word, bit in self._places(hashes):
            np.bitwise_or.at(self.words, word, bit)

    def _places(self, h: np.ndarray):
        base = ((h >> np.uint64(32)) & self.mask).astype(np.int64) * 8
        mixed = h * np.uint64(0x9E3779B97F4A7C15)
        for k in range(PROBES):
            nine = (mixed >> np.uint64(9 * k)) & np.uint64(511)
            yield base + (nine >> np.uint64(6)).astype(np.int64), np.uint64(1) << (nine & np.uint64(63))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for word, bit in self._places(hashes):
            found &= (self.words[word] & bit) != 0
        return found


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages``.

    ``rules(rule, verdict)``: a rule is a host and a path prefix in one string (``net/es/``);
    it fits its host and all subdomains where the url's path starts with the rule's. The
    longest fitting rule wins; of equal rules the verdict ``allow`` does. Without a rule
    the verdict is ``default``: what is not listed is allowed. Null rules are passed over.
    A null url, or one without ``://``, has empty host and path, which only rules of an
    empty host fit (there are none). Null ids and repeated rows are kept.

    Each url lists its keys, every suffix of its host with every prefix of its path of a
    number of labels and a length that rules have. A blocked Bloom filter of the rules
    tells which keys may be listed; only those go into the exact hash join, which removes
    the filter's false positives. The filter is built in tasks, a range of blocks each, and
    has a bound in bytes whatever the number of rules.
    """
    listed = (
        rules.filter(F.col("rule").isNotNull())
        .groupBy(F.col("rule").alias("__rule"))
        .agg(F.min("verdict").alias("__verdict"))
        .withColumn("__path_length", F.char_length("__rule") - F.char_length(F.substring_index("__rule", "/", 1)))
    )
    # Path lengths and label counts of rules: a few numbers, whatever the number of rules.
    lengths = [r[0] for r in listed.select("__path_length").distinct().orderBy("__path_length").collect()]
    parts = F.size(F.split(F.substring_index("__rule", "/", 1), r"\.")).alias("n")
    depths = [r.n for r in listed.select(parts).distinct().orderBy("n").collect()]
    h, p = url_host(F.col(f"`{url}`")), url_path(F.col(f"`{url}`"))
    rows = pages.select(F.monotonically_increasing_id().alias("__row"), F.col(f"`{id_column}`").alias("page_id"), h.alias("host"), p.alias("path"))
    rows = rows.withColumn("__labels", F.split("host", r"\."))

    def up_to(numbers: list[int], most: Column) -> Column:
        return F.filter(F.array(*[F.lit(n) for n in numbers]).cast("array<int>"), lambda n: n <= most)

    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.transform(up_to(depths, F.size("__labels")), lambda n: F.array_join(F.slice("__labels", -n, n), "."))
    )
    prefixes = F.transform(up_to(lengths, F.char_length("path")), lambda n: F.substr("path", F.lit(1), n))
    rows = rows.withColumn("__suffixes", suffixes).withColumn("__prefixes", prefixes)
    keys = F.flatten(F.transform("__suffixes", lambda s: F.transform("__prefixes", lambda x: F.concat(s, x))))
    candidates = rows.withColumn("__keys", keys).drop("__labels", "__suffixes", "__prefixes")
    bloom = pages.sparkSession.sparkContext.broadcast(_filter_of(listed))

    @F.pandas_udf("array<boolean>")
    def may_be_listed(hashed: pd.Series) -> pd.Series:
        sizes = hashed.map(len).to_numpy()
        flat = np.concatenate([np.asarray(x, np.int64) for x in hashed] or [np.zeros(0, np.int64)])
        found = bloom.value.may_hold(flat.view(np.uint64))
        return pd.Series(np.split(found, np.cumsum(sizes)[:-1]) if len(sizes) else [])

    hit = may_be_listed(F.transform("__keys", lambda k: F.xxhash64(k)))
    candidates = candidates.withColumn("__hit", hit).withColumn(
        "__keys", F.filter("__keys", lambda k, i: F.element_at("__hit", i + 1))
    )
    exploded = candidates.select("__row", "page_id", "host", "path", F.explode_outer("__keys").alias("__key"))
    joined = exploded.join(listed, F.col("__key") == F.col("__rule"), "left")
    best = joined.groupBy("__row", "page_id", "host", "path").agg(
        F.max_by(F.struct("__rule", "__verdict"), F.when(F.col("__rule").isNotNull(), F.char_length("__rule"))).alias("__best")
    )
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("__best.__rule").alias("rule"),
        F.coalesce("__best.__verdict", F.lit(default)).alias("verdict"),
    )


def _filter_of(listed: DataFrame) -> BlockedBloom:
    """The filter of the rules: each task fills one range of blocks, the driver joins them."""
    blocks = BlockedBloom.blocks_for(listed.count())
    size = min(blocks, SEGMENT_BLOCKS)
    hashed = listed.select(F.xxhash64("__rule").alias("h"))
    block = F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(blocks - 1))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = BlockedBloom(blocks, np.zeros(0, np.uint64))
        part.words = np.zeros(size * 8, np.uint64)
        h = pdf["h"].to_numpy().view(np.uint64)
        for word, bit in part._places(h):
            np.bitwise_or.at(part.words, word - int(key[0]) * size * 8, bit)
        return pd.DataFrame({"segment": [key[0]], "words": [part.words.astype("<u8").tobytes()]})

    segments = hashed.groupBy(F.floor(block / size).alias("segment")).applyInPandas(fill, "segment long, words binary")
    out = BlockedBloom(blocks)
    for r in segments.collect():  # at most FILTER_BLOCKS of 64 bytes together
        at = r.segment * size * 8
        out.words[at : at + size * 8] = np.frombuffer(r.words, "<u8")
    return out
