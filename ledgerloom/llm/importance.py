"""Target-distribution importance resampling over hashed word n-grams.

Each task keeps an Aho-Corasick dictionary of the distinct words it has met, bounded by
delimiters; a word's payload is its CRC and its length. A scan of a text emits the payloads
of its words in order, and the CRC of a run of words follows from the payloads of adjacent
words alone: crc(A + B) is crc(A) advanced by the length of B, combined with crc(B).
"""

from __future__ import annotations

import math
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import new_stage, remove_folder
from ledgerloom.llm.terms import Terms, slices

BUCKETS = 10_000
RUN_WORDS = 3
LEAST_WORDS = 20
SHARE = (5, 100)
SEED = 42
DICTIONARY_BYTES = 2 << 20  # a task's dictionary starts anew beyond this
WORD_BYTES = 64  # longer words get their payload by themselves

_POLYNOMIAL = 0xEDB88320
_ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """CRC of each byte value: what one byte does to a zero register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return table


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given for each value of each byte."""
    out = tables[0][crc & np.uint32(255)]
    for byte in range(1, 4):
        out = out ^ tables[byte][(crc >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


class Advance:
    """Advances CRCs by a number of bytes: maps for powers of two, each the square of the last."""

    def __init__(self) -> None:
        self.step = _byte_table()
        values = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
        self.powers = [self.step[values & np.uint32(255)] ^ (values >> np.uint32(8))]

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out, bit = crc.copy(), 0
        while (lengths >> bit).any():
            if bit == len(self.powers):
                self.powers.append(_apply(self.powers[-1], self.powers[-1]))
            at = np.flatnonzero((lengths >> bit) & 1)
            out[at] = _apply(self.powers[bit], out[at])
            bit += 1
        return out

    def space(self, crc: np.ndarray) -> np.ndarray:
        """CRC of each text with one space after it."""
        register = crc ^ _ALL
        return self.step[(register ^ np.uint32(32)) & np.uint32(255)] ^ (register >> np.uint32(8)) ^ _ALL

    def join(self, left: np.ndarray, right: np.ndarray, right_lengths: np.ndarray) -> np.ndarray:
        """CRC of "left right" from those of its parts."""
        return self(self.space(left), right_lengths) ^ right


class Dictionary:
    """Delimiter-bounded words with payloads (CRC in the low 32 bits, length above)."""

    def __init__(self, capacity: int = DICTIONARY_BYTES) -> None:
        self.capacity, self.size = capacity, 0
        self.words = ahocorasick.Automaton()

    def learn(self, values: pa.Array) -> None:
        """Adds the words not held yet. They are read as single bytes, one character each."""
        if self.size > self.capacity:
            self.words, self.size = ahocorasick.Automaton(), 0
        before = self.size
        for word in pc.unique(values).to_pylist():
            key = f" {word.decode('latin-1')} "
            if key not in self.words:
                self.words.add_word(key, zlib.crc32(word) | len(word) << 32)
                self.size += len(key)
        if self.size > before:
            self.words.make_automaton()

    def payloads(self, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
        """(CRC, length) of every term of a part, in order."""
        crc, lengths = np.zeros(len(terms.values), np.uint32), terms.lengths
        short = lengths <= WORD_BYTES
        for i in np.flatnonzero(~short).tolist():
            crc[i] = zlib.crc32(terms.values[i].as_py())
        own = terms.values if short.all() else terms.values.filter(pa.array(short))
        if not len(own):
            return crc, lengths
        self.learn(own)
        # The words again, one delimiter between each two and at both ends.
        size = lengths[short]
        spaced = np.full(int(size.sum()) + len(size) + 1, 32, np.uint8)
        spaced[np.arange(int(size.sum())) + np.repeat(np.arange(1, len(size) + 1), size)] = terms.bytes[np.repeat(short, lengths)]
        text = spaced.tobytes().decode("latin-1")
        emitted = np.fromiter((payload for _, payload in self.words.iter(text)), np.int64, len(size))
        crc[short] = (emitted & 0xFFFFFFFF).astype(np.uint32)
        return crc, lengths


def _features(terms: Terms, dictionary: Dictionary, advance: Advance, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first term, bucket) of every run of 1, 2 and 3 words of each text."""
    crc, lengths = dictionary.payloads(terms)
    owner, out, runs = terms.owner(), [], crc
    for n in range(1, RUN_WORDS + 1):
        if n > 1:
            # The run of n words at i is the run of n - 1 words and the word after it.
            runs = advance.join(runs[:-1], crc[n - 1 :], lengths[n - 1 :]) if len(runs) else runs
        whole = owner[: len(runs)] == owner[n - 1 :] if len(runs) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        out.append((at, (runs[at] % np.uint32(buckets)).astype(np.int64)))
    return out


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket over all features of the one text column of ``texts``."""

    def run(batches):
        dictionary, advance = Dictionary(), Advance()
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, 0):
            for _, bucket in _features(Terms(part.column(0)), dictionary, advance, buckets):
                total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over that of the source."""
    width = len(source)
    s_all, t_all = float(source.sum() + width), float(target.sum() + width)
    return np.array(
        [math.floor(1000 * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def _weighted(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    held = rows.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        dictionary, advance, gain = Dictionary(), Advance(), held.value
        for part in slices(batches, 1):
            terms = Terms(part.column(1))
            at_term = np.zeros(len(terms.values) + 1, np.int64)
            for at, bucket in _features(terms, dictionary, advance, len(gain)):
                at_term[at + 1] += gain[bucket]
            sums, words = np.cumsum(at_term)[terms.first], terms.counts()
            features = sum(np.maximum(words - n, 0) for n in range(RUN_WORDS))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words), pa.array(features), pa.array(np.diff(sums))],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = SHARE,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    id_column: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; the drawn ones have a rank.

    Words are runs of ASCII letters, digits and non-ASCII characters of the whole text, only
    A-Z lower-cased. Features are all runs of one to three words, repeats counted, hashed
    into ``buckets``. A document's weight sums the gains of its features' buckets; its score
    adds Gumbel noise fixed by ``seed`` and id. Of the documents with at least
    ``least_words`` words, the share (numerator, denominator) with the highest scores is
    drawn; equal scores go by ascending id, missing ids last.

    Null and empty texts have no features and weight 0. Missing ids count as the empty text
    in the noise; repeated rows are rows of their own and share their noise. Empty tables
    give no rows; without target texts all buckets have a target count of 0.

    Two scans read the texts: the first counts the buckets, the second scores. Only counts
    per bucket reach the driver. Ranks come from a range partitioning of the scored rows, in
    which a row number breaks the last ties, so no task sorts more than its range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"))
    source = bucket_counts(rows.select("t"), buckets)
    gains = bucket_gains(source, bucket_counts(target.select(F.col(f"`{target_text}`").alias("t")), buckets))
    salted = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(salted, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = _weighted(rows, gains).withColumn("score", F.col("weight") + noise)
    scored, where = new_stage(scored.withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    last = ~(F.col("n_words") >= least_words)
    order = [last.asc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    # After the sort, the id's high bits are the range and its low bits the place in it.
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed, _ = new_stage(placed.drop("row"), "importance-places")
    remove_folder(spark, where)
    able = F.count(F.when(F.col("n_words") >= least_words, 1)).alias("n")
    ranges = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(able).orderBy("range").collect()
    drawn = share[0] * sum(r.n for r in ranges) // share[1]
    before = np.cumsum([0] + [r.n for r in ranges])[:-1].tolist()
    starts = spark.createDataFrame([(r.range, b) for r, b in zip(ranges, before, strict=True)], "range long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("range", F.shiftright("place", 33)).join(F.broadcast(starts), "range")
    rank = F.when((F.col("n_words") >= least_words) & (rank <= drawn), rank)
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
