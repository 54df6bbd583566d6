"""Approximate nearest neighbours: inverted lists scanned dimension block by dimension block.

Vectors are rotated at random, so that a part of the dimensions estimates the whole
distance, and stored as tiles of one list each, every block of dimensions a column of its
own. A scan adds up partial distances block by block; after each block a hypothesis test
abandons the candidates whose distance is, with high confidence, beyond the query's current
k-th best. Survivors of all blocks get their exact distance from the original vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import merge_best, new_stage

TOP = 10
SAMPLE_ROWS = 32_768  # rows the lists, and the number of lists to probe, are fitted on
MOST_LISTS = 1024
ROUNDS = 10  # of k-means
TRIALS = 256  # sampled queries the probes are calibrated with
TARGET_RECALL = 0.97
BLOCK_DIMS = 16
CONFIDENCE = 2.1  # standard widths of the hypothesis test
TILE = 1024
QUERY_BYTES = 32 << 20
QUERY_TILE = 1024
LEAST_MET = 64  # rows a query's probed lists must exceed
SEED = 11


@dataclass
class Lists:
    """What is fitted: a rotation, the lists' centres and how many lists a query probes."""

    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    def assign(self, rotated: np.ndarray) -> np.ndarray:
        return np.argmin(self.distances(rotated), axis=1).astype(np.int32)

    def distances(self, rotated: np.ndarray) -> np.ndarray:
        c = self.centres
        return (c * c).sum(axis=1)[None, :] - 2 * rotated @ c.T

    def order(self, rotated: np.ndarray) -> np.ndarray:
        """Lists of each query, nearest first."""
        return np.argsort(self.distances(rotated), axis=1, kind="stable").astype(np.int32)


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as doubles, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def fit_lists(sample: np.ndarray, total: int, k: int = TOP) -> Lists:
    """Lists for ``total`` vectors, from a bounded sample of them.

    The probes are the fewest lists that hold ``TARGET_RECALL`` of the sampled queries'
    true neighbours inside the sample. Neighbours in the whole table are nearer than those
    in a sample, so they share a list more often.
    """
    rng = np.random.default_rng(SEED)
    width = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    points = sample @ rotation
    count = max(1, min(MOST_LISTS, math.isqrt(total), len(points) // 16))
    lists = Lists(rotation, points[rng.choice(len(points), count, replace=False)] if len(points) else np.zeros((1, width)), 1)
    for _ in range(ROUNDS if count > 1 else 0):
        of = lists.assign(points)
        sizes = np.bincount(of, minlength=count)
        sums = np.zeros_like(lists.centres)
        np.add.at(sums, of, points)
        lists.centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], lists.centres)
    if count > 1:
        of, trials = lists.assign(points), rng.choice(len(points), min(TRIALS, len(points)), replace=False)
        near = (points * points).sum(axis=1)[None, :] - 2 * points[trials] @ points.T
        near[np.arange(len(trials)), trials] = np.inf
        k = min(k, len(points) - 1)
        best = np.argpartition(near, k - 1, axis=1)[:, :k]
        place = np.argsort(lists.order(points[trials]), axis=1)  # of each list in the query's order
        needed = np.sort(np.take_along_axis(place, of[best], axis=1).ravel())
        lists.probes = int(needed[math.ceil(TARGET_RECALL * len(needed)) - 1]) + 1
    return lists


def _dims(width: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, width)) for a in range(0, width, BLOCK_DIMS)]


def _index_schema(width: int, element: str) -> str:
    blocks = ", ".join(f"b{i} binary" for i in range(len(_dims(width))))
    return f"list int, n int, row binary, id binary, original array<{element}>" + (f", {blocks}" if blocks else "")


@dataclass
class Index:
    """Tiles of the lists as a written table, and what was fitted."""

    tiles: DataFrame
    lists: Lists
    width: int
    sizes: np.ndarray


def usable_rows(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v) of the rows with an id and a vector of finite components, not all zero."""
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~wrong & F.exists("v", lambda x: x != 0))


def build_index(table: DataFrame, k: int = TOP, id_column: str = "vec_id", vector: str = "embedding") -> Index | None:
    """Every usable row of ``table`` in tiles of its list; None without any.

    Rows are ranged by (list, row number), so that a list holding a large share of all rows
    spreads over many tasks and files; a tile holds at most ``TILE`` rows of one list.
    """
    rows = usable_rows(table, id_column, vector)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not facts.n:
        return None
    width, total = facts.width, facts.n
    sample = rows.select("v")
    if total > SAMPLE_ROWS:
        sample = sample.sample(min(1.0, 1.1 * SAMPLE_ROWS / total), SEED).limit(SAMPLE_ROWS)
    lists = fit_lists(dense(sample.toArrow().column("v"), width), total, k)
    fitted = table.sparkSession.sparkContext.broadcast(lists)
    element = rows.schema["v"].dataType.elementType.simpleString()

    def assign(batches):
        for b in batches:
            of = fitted.value.assign(dense(b.column(2), width) @ fitted.value.rotation)
            yield pa.RecordBatch.from_arrays([pa.array(of), *b.columns], names=["list", "row", "id", "v"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    assigned = numbered.mapInArrow(assign, f"list int, row long, id long, v array<{element}>")
    ranged = assigned.repartitionByRange("list", "row").sortWithinPartitions("list", "row")

    def tile(batches):
        for b in batches:
            of = b.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]) if len(of) else [0]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                for a in range(int(s), int(e), TILE):
                    yield _tile(b.slice(a, min(TILE, int(e) - a)), fitted.value.rotation, width)

    tiles, _ = new_stage(ranged.mapInArrow(tile, _index_schema(width, element)), "neighbour-index")
    sizes = np.zeros(len(lists.centres), np.int64)
    for r in tiles.groupBy("list").agg(F.sum("n").alias("n")).collect():  # at most a row per list
        sizes[r.list] = r.n
    return Index(tiles, lists, width, sizes)


def _tile(part: pa.RecordBatch, rotation: np.ndarray, width: int) -> pa.RecordBatch:
    rotated = (dense(part.column(3), width) @ rotation).astype("<f4")
    ids = [part.column(c).to_numpy().astype("<i8").tobytes() for c in (1, 2)]
    values = part.column(3)
    # All original vectors of the tile as one list: their own element type, filled to one width.
    flat = dense(values, width).ravel()
    original = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat).cast(values.type.value_type))
    blocks = [pa.array([np.ascontiguousarray(rotated[:, d].T).tobytes()], pa.binary()) for d in _dims(width)]
    return pa.RecordBatch.from_arrays(
        [pa.array([part.column(0)[0].as_py()], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([ids[0]], pa.binary()),
         pa.array([ids[1]], pa.binary()), original, *blocks],
        names=["list", "n", "row", "id", "original", *[f"b{i}" for i in range(len(blocks))]],
    )


class _Tile:
    """A read tile: row numbers, ids, original vectors and rotated blocks (dims x rows)."""

    def __init__(self, b: pa.RecordBatch, i: int, width: int) -> None:
        self.list, n = b.column(0)[i].as_py(), b.column(1)[i].as_py()
        self.row, self.id = (np.frombuffer(b.column(c)[i].as_py(), "<i8") for c in (2, 3))
        self.original = b.column(4)[i].values.to_numpy(zero_copy_only=False).reshape(n, width)
        self.blocks = [np.frombuffer(b.column(5 + j)[i].as_py(), "<f4").reshape(-1, n) for j in range(len(_dims(width)))]


def _queries(index: Index, every: int) -> DataFrame:
    """(row, id, v, lists): each query and the lists it probes."""
    probes, sizes, width = index.lists.probes, index.sizes, index.width
    fitted = index.tiles.sparkSession.sparkContext.broadcast(index.lists)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                t = _Tile(b, i, width)
                at = np.flatnonzero(t.id % every == 0)
                if not len(at):
                    continue
                v = t.original[at].astype(np.float64)
                order = fitted.value.order(v @ fitted.value.rotation)
                # Beyond the calibrated probes, more lists as long as too few rows are met.
                met = np.cumsum(sizes[order], axis=1)
                count = np.maximum(probes, (met <= LEAST_MET).sum(axis=1) + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.row[at]), pa.array(t.id[at]), pa.array(list(v), pa.list_(pa.float64())),
                     pa.array([o[:c] for o, c in zip(order, count.tolist(), strict=True)], pa.list_(pa.int32()))],
                    names=["row", "id", "v", "lists"],
                )

    return index.tiles.mapInArrow(run, "row long, id long, v array<double>, lists array<int>")


class _Block:
    """A bounded block of queries and, per list, the queries that probe it."""

    def __init__(self, part: pa.Table, lists: Lists, width: int) -> None:
        self.row, self.v = part.column("row").to_numpy(), dense(part.column("v"), width)
        rotated = (self.v @ lists.rotation).astype(np.float32)
        self.blocks = [np.ascontiguousarray(rotated[:, d]) for d in _dims(width)]
        probed = part.column("lists").combine_chunks()
        owner = np.repeat(np.arange(len(self.row)), np.diff(probed.offsets.to_numpy()))
        of = probed.flatten().to_numpy()
        order = np.argsort(of, kind="stable")
        self.probing = owner[order]
        self.first = np.searchsorted(of[order], np.arange(len(lists.centres) + 1))

    def of_list(self, number: int) -> np.ndarray:
        return self.probing[self.first[number] : self.first[number + 1]]


class _Best:
    """The ``k`` nearest rows of each query met so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.distance = np.full((queries, k), np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def update(self, q: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        k = self.distance.shape[1]
        touched = np.unique(q)
        q = np.concatenate([np.repeat(touched, k), q])
        distance = np.concatenate([self.distance[touched].ravel(), distance])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, distance, q))
        at = np.searchsorted(q[order], touched)[:, None] + np.arange(k)[None, :]
        self.distance[touched], self.id[touched] = distance[order][at], ids[order][at]


def survivors(tile: _Tile, block: _Block, q: np.ndarray, best: _Best, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs of a tile that no test abandons.

    With d of D dimensions seen, a candidate is abandoned if its partial distance exceeds
    (d / D) (1 + c / sqrt(d))^2 times the squared k-th best; with all seen, if it exceeds it.
    """
    limit = best.distance[q, -1] ** 2
    partial, pairs, seen = np.zeros((len(q), len(tile.id)), np.float32), None, 0
    for n, dims in enumerate(_dims(width)):
        a, b = block.blocks[n][q], tile.blocks[n]
        if pairs is None:
            partial += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=0)[None, :] - 2 * (a @ b)
        else:
            x, y = pairs
            partial += ((a[x] - b.T[y]) ** 2).sum(axis=1)
        seen += dims.stop - dims.start
        share = seen / width
        bound = limit * (share * (1 + CONFIDENCE / math.sqrt(seen)) ** 2 if seen < width else 1.0) * (1 + 1e-4) + 1e-9
        if pairs is None:
            alive = partial <= bound[:, None]
            if seen == width or alive.mean() < 0.2:
                pairs = np.nonzero(alive)
                partial = partial[pairs]
        else:
            alive = partial <= bound[x]
            pairs, partial = (x[alive], y[alive]), partial[alive]
    return pairs


def _scan(index: Index, queries: pa.Table, k: int) -> DataFrame:
    width, context = index.width, index.tiles.sparkSession.sparkContext
    held = context.broadcast(_Block(queries, index.lists, width))

    def run(batches):
        block = held.value
        best = _Best(len(block.row), k)
        for b in batches:
            for i in range(b.num_rows):
                t = _Tile(b, i, width)
                probing = block.of_list(t.list)
                for s in range(0, len(probing), QUERY_TILE):
                    q = probing[s : s + QUERY_TILE]
                    x, y = survivors(t, block, q, best, width)
                    own = block.row[q[x]] == t.row[y]
                    x, y = q[x[~own]], y[~own]
                    for a in range(0, len(x), 1 << 16):
                        u, c = x[a : a + (1 << 16)], y[a : a + (1 << 16)]
                        exact = np.sqrt(((block.v[u] - t.original[c].astype(np.float64)) ** 2).sum(axis=1))
                        worst = best.distance[u, -1]
                        better = (exact < worst) | ((exact == worst) & (t.id[c] < best.id[u, -1]))
                        best.update(u[better], exact[better], t.id[c][better])
        q, n = np.nonzero(best.distance < np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.row[q]), pa.array(best.id[q, n]), pa.array(best.distance[q, n])], names=["query", "vec_id", "score"]
        )

    entries = index.tiles.mapInArrow(run, "query long, vec_id long, score double")
    return merge_best(entries, ["query"], [F.asc("score"), F.asc("vec_id")], k)


def nearest(
    table: DataFrame, every: int = 100, k: int = TOP, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found rows by Euclidean distance.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the
    query's own; ``score`` is the exact distance of the original vectors, ties go to the
    smaller id. Vectors that are null, zero or hold null or non-finite components, and rows
    without id, take no part. Shorter vectors count as filled with zeros. Repeated rows are
    candidates of their own; of several query rows under one id each has its own ranks. With
    at most ``k`` candidates all are returned; an empty table gives no rows.

    The lists, and how many of them are probed, are fitted on at most ``SAMPLE_ROWS`` rows;
    all rows are indexed. Queries run in blocks of about ``QUERY_BYTES``, the only data
    broadcast besides the fitted lists; a block is one scan of the tiles.
    """
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    index = build_index(table, k, id_column, vector)
    if index is None:
        return spark.createDataFrame([], schema)
    queries, _ = new_stage(_queries(index, every), "neighbour-queries")
    count = queries.count()
    blocks, out = max(1, -(-count * (index.width * 24 + 4 * index.lists.probes) // QUERY_BYTES)), None
    for n in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == n).toArrow()
        if not part.num_rows:
            continue
        ids = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
        found = _scan(index, part, k).join(ids, "query").select("query_id", "rank", "vec_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out
