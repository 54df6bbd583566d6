"""Ranked lexical search, reversed: documents stream through an index of the items' terms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import merge_best
from ledgerloom.llm.terms import Terms, slices

TOP = 10
BLOCK_BYTES = 16 << 20
TILE_CELLS = 1 << 21
SATURATION, LENGTH_SHARE = 8, 75  # tenths of a term count; percent
_EXACT = 1 << 53


class ItemIndex:
    """Inverted index of a bounded block of items: term -> (item, occurrences in the item)."""

    def __init__(self, texts: list[str | None]) -> None:
        terms = Terms(pa.array(texts, pa.string()))
        coded = terms.values.dictionary_encode()
        self.vocabulary = coded.dictionary
        term, owner = coded.indices.to_numpy().astype(np.int64), terms.owner()
        pair, repeats = np.unique(term * max(1, len(texts)) + owner, return_counts=True)
        self.item, self.repeats = pair % max(1, len(texts)), repeats
        self.first = np.searchsorted(pair // max(1, len(texts)), np.arange(len(self.vocabulary) + 1))
        self.items = len(texts)

    def term_counts(self, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, tf) of the indexed terms in each text."""
        found = pc.index_in(terms.values, value_set=self.vocabulary)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        term = pc.drop_null(found).to_numpy().astype(np.int64)
        width = max(1, len(self.vocabulary))
        pair, tf = np.unique(terms.owner()[known] * width + term, return_counts=True)
        return pair // width, pair % width, tf


def weight(documents: int, df: int) -> int:
    """Weight of a term in ``df`` of ``documents``."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _statistics(rows: DataFrame, index) -> DataFrame:
    """(term, n): documents per indexed term; term -1: documents with terms, -2: all terms."""

    def run(batches):
        held = index.value
        df, documents, total = np.zeros(len(held.vocabulary), np.int64), 0, 0
        for part in slices(batches, 1):
            terms = Terms(part.column(1))
            _, term, _ = held.term_counts(terms)
            df += np.bincount(term, minlength=len(df))
            documents += int((terms.counts() > 0).sum())
            total += len(terms.values)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [documents, total]))], names=["term", "n"]
        )

    return rows.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class _Heaps:
    """The ``k`` best entries of each item so far; ties to the smaller id, missing ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.floor = k, np.ones(items, np.int64)
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        self.waiting: list[list[np.ndarray]] = []
        self.size = 0

    def push(self, item: np.ndarray, doc: np.ndarray, missing: np.ndarray, score: np.ndarray) -> None:
        self.waiting.append([item, doc, missing, score])
        self.size += len(item)
        if self.size > max(1 << 16, 2 * self.k * len(self.floor)):
            self.settle()

    def settle(self) -> None:
        item, doc, missing, score = (np.concatenate(z) for z in zip(self.held, *self.waiting, strict=True))
        order = np.lexsort((doc, missing, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(len(self.floor) + 1))
        rank = np.arange(len(item)) - np.repeat(first[:-1], np.diff(first))
        keep = rank < self.k
        self.held = [item[keep], doc[order][keep], missing[order][keep], score[order][keep]]
        last = rank == self.k - 1
        self.floor[item[last]] = score[order][last]
        self.waiting, self.size = [], 0


def _scores(held: ItemIndex, text: np.ndarray, gain: np.ndarray, term: np.ndarray, texts: int) -> np.ndarray:
    """Score of each (text, item) of a tile, from the gain of each (text, term)."""
    lengths = held.first[term + 1] - held.first[term]
    at = np.repeat(held.first[term] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    cell = np.repeat(text, lengths) * held.items + held.item[at]
    added = np.repeat(gain, lengths) * held.repeats[at]
    if int(gain.max(initial=0)) * int(held.repeats.max(initial=0)) * max(1, len(gain)) < _EXACT:
        total = np.bincount(cell, added, minlength=texts * held.items).astype(np.int64)
    else:
        total = np.zeros(texts * held.items, np.int64)
        np.add.at(total, cell, added)
    return total.reshape(texts, held.items)


def _search_block(rows: DataFrame, index, stats: dict[int, int], k: int) -> DataFrame:
    documents, total = stats.get(-1, 0), stats.get(-2, 0)
    width = len(index.value.vocabulary)
    weights = np.array([weight(documents, stats.get(t, 0)) for t in range(width)], np.int64)
    weights = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        held, w = index.value, weights.value
        heaps = _Heaps(held.items, k)
        tile = max(1, TILE_CELLS // max(1, held.items))
        for part in slices(batches, 1):
            ids = part.column(0)
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(ids, 0).to_numpy()
            terms = Terms(part.column(1))
            text, term, tf = held.term_counts(terms)
            # Python integers: 75 n N may pass 64 bits on a very long text of a very large corpus.
            m = np.array([100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // total for n in terms.counts().tolist()], np.int64)
            gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + SATURATION * m[text]))
            for a in range(0, len(ids), tile):
                s, e = np.searchsorted(text, [a, a + tile])
                size = min(tile, len(ids) - a)
                score = _scores(held, text[s:e] - a, gain[s:e], term[s:e], size)
                d, item = np.nonzero(score >= heaps.floor)
                heaps.push(item, ids[a + d], missing[a + d], score[d, item])
        heaps.settle()
        item, doc, missing, score = heaps.held
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(doc, mask=missing), pa.array(score)], names=["item", "doc_id", "score"]
        )

    if not total:  # no document has a term
        return rows.sparkSession.createDataFrame([], "item long, doc_id long, score long, rank int")
    entries = rows.mapInArrow(run, "item long, doc_id long, score long")
    return merge_best(entries, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    Terms are maximal runs of ASCII letters, digits and non-ASCII characters of the whole
    text, A-Z lower-cased. A term's weight falls with the documents that hold it; its gain
    saturates with its occurrences and falls with the document's length; an item's terms
    count with their repeats. Equal scores go by ascending id, missing ids last.

    Null and empty texts have no terms: such documents match nothing and such items have
    no rows. Repeated documents are documents of their own, and each item row has a
    ranking of its own, under its id (null ids included). Empty tables give no rows.

    Items form blocks of about ``BLOCK_BYTES`` of text, whose inverted index is all that is
    broadcast (a text beyond that is a block alone). For a block, one scan of the documents
    counts what the weights need, a second one streams the documents' term counts through
    the index; each task keeps bounded heaps per item, and the heaps are merged in a tree.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"))
    wanted = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).filter("t <> ''")
    wanted = wanted.groupBy("t", "i").agg(F.count("*").alias("n"))  # repeated rows are ranked once
    size = wanted.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks, out = max(1, -(-size // BLOCK_BYTES)), None
    for n in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("t", "i"), F.lit(blocks)) == n).select("i", "n", "t").toArrow()
        if not part.num_rows:
            continue
        index = spark.sparkContext.broadcast(ItemIndex(part.column("t").to_pylist()))
        if not len(index.value.vocabulary):
            continue
        stats = {r.term: r.n for r in _statistics(rows, index).collect()}  # at most a row per indexed term
        names = spark.createDataFrame(
            pa.table({"item": pa.array(range(part.num_rows), pa.int64()), "item_id": part.column("i"), "rows": part.column("n")})
        )
        named = _search_block(rows, index, stats, k).join(F.broadcast(names), "item")
        found = named.withColumn("copy", F.explode(F.sequence(F.lit(1), "rows"))).select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = items.schema[item_id].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
