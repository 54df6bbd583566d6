"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import merge_best, new_stage

TOP = 20
SCALE = 64
QUERY_BLOCK = 65_536
SLICES = 2
TILE = 2048


def _vectors(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Usable row numbers and their integer vectors (floor(64 x), as doubles)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(column)), sizes)
    bad = np.bincount(owner, ~np.isfinite(flat), minlength=len(column)) > 0
    usable = column.is_valid().to_numpy(zero_copy_only=False) & ~bad
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(column), width))
    inside = np.arange(width)[None, :] < sizes[:, None]
    with np.errstate(invalid="ignore", over="ignore"):
        out[inside] = np.floor(SCALE * flat)
    rows = np.flatnonzero(usable)
    return rows, out[rows]


class _Block:
    """A bounded block of queries, ready for scoring against candidate tiles."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray) -> None:
        self.rows, self.vectors = rows, vectors

    def partial_scores(self, queries: slice, candidates: np.ndarray) -> list[np.ndarray]:
        """One matrix of partial inner products per slice of the dimensions."""
        q, width = self.vectors[queries], max(self.vectors.shape[1], candidates.shape[1])
        q, c = _widen(q, width), _widen(candidates, width)
        top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, width)
        if top >= 2**53:  # beyond exact doubles: Python integers
            q, c = (np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (q, c))
        elif top < 2**24:
            q, c = q.astype(np.float32), c.astype(np.float32)
        return [q[:, s] @ c[:, s].T for s in _slices(width)]


def _slices(width: int) -> list[slice]:
    cuts = [width * i // SLICES for i in range(SLICES + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _widen(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _tiles(batches):
    """(row numbers, ids, vectors) of at most ``TILE`` usable candidates."""
    for b in batches:
        at, vectors = _vectors(b.column(2))
        rows, ids = (b.column(c).to_numpy(zero_copy_only=False)[at] for c in (0, 1))
        for i in range(0, len(at), TILE):
            yield rows[i : i + TILE], ids[i : i + TILE], vectors[i : i + TILE]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k largest of each row, in no order."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def top_inner_products(
    table: DataFrame, every: int = 20, k: int = TOP, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    Components x become floor(64 x). Queries are the rows whose id is divisible by
    ``every``; candidates are all rows but the query's own. Ties go to the smaller id.
    Repeated rows are candidates of their own, and of several query rows under one id each
    has its own ranks. Vectors that are null or hold null or non-finite components, and rows
    without id, take no part. Shorter vectors count as filled with zeros. Without rows, or
    with a single one, the result is empty.

    The dimensions are cut into slices, whose partial products sum to the score.
    1. Each task lists its best ``k`` entries of every slice; the k-th best of the listed
       entries' scores over all tasks is a safe cutoff: k rows reach it.
    2. The cutoffs are broadcast. An entry that reaches a query's cutoff has, in some
       slice, at least an even share of it; each task collects the entries that do.
    3. The collected entries' scores are completed exactly, those below the cutoff go,
       each task sends its ``k`` best, and the lists are merged in a tree.
    Queries run in blocks of at most ``QUERY_BLOCK``, the only data broadcast.
    """
    spark, v = table.sparkSession, F.col(f"`{vector}`")
    plain = isinstance(table.schema[vector].dataType.elementType, (T.FloatType, T.DoubleType))
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), (v if plain else v.cast("array<double>")).alias("v"))
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
    # Written once, so that a row keeps its number in every scan.
    rows, _ = new_stage(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "numbered-vectors")
    queries = rows.filter(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    names, out = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id")), None
    for n in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == n).toArrow()
        if not part.num_rows:
            continue
        found = _search_block(rows, part, k).join(names, "query").select("query_id", "rank", "vec_id", "score")
        out = found if out is None else out.unionByName(found)
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.createDataFrame([], schema) if out is None else out


def _search_block(rows: DataFrame, part: pa.Table, k: int) -> DataFrame:
    spark = rows.sparkSession
    # A usable vector has no nulls, so its column reads as one flat array.
    usable, vectors = _vectors(part.column("v"))
    block = _Block(part.column("row").combine_chunks().to_numpy()[usable], vectors)
    block = spark.sparkContext.broadcast(block)

    def local_lists(batches):
        b, lists = block.value, {}
        for numbers, _, vectors in _tiles(batches):
            for i in range(0, len(b.rows), TILE):
                part = slice(i, i + TILE)
                partial = b.partial_scores(part, vectors)
                own = b.rows[part][:, None] == numbers[None, :]
                score = sum(partial[1:], partial[0])
                listed = np.zeros(score.shape, bool)
                for s in partial:
                    np.put_along_axis(listed, _best(s, k), True, axis=1)
                score = np.where(listed & ~own, score.astype(np.float64), -np.inf)
                best = np.take_along_axis(score, _best(score, k), axis=1)
                lists[i] = best if i not in lists else np.take_along_axis(
                    both := np.concatenate([lists[i], best], axis=1), _best(both, k), axis=1
                )
        for i, best in lists.items():
            q, _ = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.rows[i : i + TILE][q]), pa.array(best[best > -np.inf])], names=["query", "score"]
            )

    lists = rows.mapInArrow(local_lists, "query long, score double")
    cut = merge_best(lists, ["query"], [F.desc("score")], k).filter(F.col("rank") == k)
    cutoffs = {r.query: r.score for r in cut.select("query", "score").collect()}  # one per query of the block
    cutoff = np.array([cutoffs.get(q, -np.inf) for q in block.value.rows.tolist()])
    # Above 2**53 the double may lie over the exact k-th score, by less than one step.
    cutoff = np.where(np.abs(cutoff) >= 2**53, np.nextafter(cutoff, -np.inf), cutoff)
    safe = spark.sparkContext.broadcast(cutoff)

    def sufficient(batches):
        b, held = block.value, {}
        for numbers, ids, vectors in _tiles(batches):
            for i in range(0, len(b.rows), TILE):
                part = slice(i, i + TILE)
                partial = b.partial_scores(part, vectors)
                share = safe.value[part][:, None] / len(partial)
                enough = partial[0] >= share
                for s in partial[1:]:
                    enough |= s >= share
                q, c = np.nonzero(enough)
                score = sum((s[q, c].astype(object if s.dtype == object else np.float64) for s in partial[1:]), partial[0][q, c])
                keep = (score >= safe.value[part][q]) & (b.rows[part][q] != numbers[c])
                q, c, score = q[keep] + i, c[keep], score[keep]
                now = [q, ids[c], score]
                held[i] = now if i not in held else [np.concatenate(z) for z in zip(held[i], now, strict=True)]
                if len(held[i][0]) > 4 * k * TILE:
                    held[i] = _cut(*held[i], k)
        for q, c, score in held.values():
            q, c, score = _cut(q, c, score, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.rows[q]), pa.array(c, pa.int64()), pa.array([int(x) for x in score], pa.int64())],
                names=["query", "vec_id", "score"],
            )

    entries = rows.mapInArrow(sufficient, "query long, vec_id long, score long")
    return merge_best(entries, ["query"], [F.desc("score"), F.asc("vec_id")], k)


def _cut(q: np.ndarray, c: np.ndarray, score: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best entries of each query; ties to the smaller id."""
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return [q[rank < k], c[rank < k], score[rank < k]]
