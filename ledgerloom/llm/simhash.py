"""SimHash near-duplicate groups with pivot distance tables.

Fingerprints within ``RADIUS`` differing bits are linked; groups are the connected
components. Blocks of bits route fingerprints to tasks so that every linked pair meets
in one; there, tables of distances to reference fingerprints discard pairs whose
distances to any reference differ by more than the radius, and the rest are verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import new_stage, remove_folder

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
PIVOTS = 16
TILE = 4096
BUCKET_ROWS = 2048


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a whole text; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(len(words), shingle_words) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        part = h[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) per row; ``fp`` as a signed 64-bit number."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                fps = np.array([fingerprint(t, shingle_words) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def routes(count: int, radius: int = RADIUS) -> list[int]:
    """Bit masks such that fingerprints within ``radius`` agree on at least one of them.

    With b blocks of bits, at most ``radius`` blocks differ, so b - radius blocks agree:
    one mask per choice of that many blocks. The smallest b whose buckets hold about
    ``BUCKET_ROWS`` of ``count`` fingerprints is taken; all give the same links.
    """
    for b in range(radius + 1, radius + 5):
        cuts = [64 * i // b for i in range(b + 1)]
        blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(cuts)]
        masks = [sum(c) for c in itertools.combinations(blocks, b - radius)]
        if count >> min(m.bit_count() for m in masks) <= BUCKET_ROWS:
            break
    return masks


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints from a fixed seed."""
    return np.random.default_rng(64).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def linked_pairs(a: np.ndarray, b: np.ndarray, same: bool, radius: int, refs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``a`` and ``b`` within ``radius``, by pivot tables; i < j if ``same``."""
    first_a, first_b = np.bitwise_count(a ^ refs[0]), np.bitwise_count(b ^ refs[0])
    order_a, order_b = np.argsort(first_a, kind="stable"), np.argsort(first_b, kind="stable")
    table_a = np.bitwise_count(a[order_a, None] ^ refs[None, :]).astype(np.int8)
    table_b = np.bitwise_count(b[order_b, None] ^ refs[None, :]).astype(np.int8)
    for i in range(0, len(a), 256):
        rows = table_a[i : i + 256]
        lo = np.searchsorted(table_b[:, 0], rows[0, 0] - radius, "left")
        hi = np.searchsorted(table_b[:, 0], rows[-1, 0] + radius, "right")
        near = np.abs(rows[:, None, 0] - table_b[None, lo:hi, 0]) <= radius
        near &= np.abs(rows[:, None, 1] - table_b[None, lo:hi, 1]) <= radius
        x, y = np.nonzero(near)
        x, y = x + i, y + lo
        for k in range(2, len(refs)):
            close = np.abs(table_a[x, k] - table_b[y, k]) <= radius
            x, y = x[close], y[close]
        x, y = order_a[x], order_b[y]
        if same:
            upper = x < y
            x, y = x[upper], y[upper]
        close = np.bitwise_count(a[x] ^ b[y]) <= radius
        yield x[close], y[close]


class _Forest:
    """Labels of a small set of nodes; links arrive in arrays."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.label[x], self.label[y]
        apart = a != b
        if not apart.any():
            return
        pairs = np.unique(np.stack([np.maximum(a, b)[apart], np.minimum(a, b)[apart]], axis=1), axis=0)
        parent: dict[int, int] = {}

        def find(u: int) -> int:
            while (p := parent.get(u, u)) != u:
                parent[u] = parent.get(p, p)
                u = p
            return u

        for u, v in pairs.tolist():
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        to = np.arange(len(self.label))
        for u in parent:
            to[u] = find(u)
        self.label = to[self.label]


def _tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smaller node) of a forest that joins the linked fingerprints."""
    if b is None:
        nodes = np.sort(a)
        forest = _Forest(len(nodes))
        for x, y in linked_pairs(nodes, nodes, True, radius, refs):
            forest.link(x, y)
    else:
        nodes = np.concatenate([a, b])
        forest = _Forest(len(nodes))
        for x, y in linked_pairs(a, b, False, radius, refs):
            forest.link(x, y + len(a))
    member = np.flatnonzero(forest.label != np.arange(len(nodes)))
    return nodes[member], nodes[forest.label[member]]


def links(classes: DataFrame, count: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v) edges that connect exactly the components of linked fingerprints.

    ``classes`` has one row per distinct fingerprint ``fp``. Buckets of more than
    ``tile`` rows are cut into chunks, and each pair of chunks is a task of its own.
    """
    masks = routes(count, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])
    routed = classes.select("fp", F.explode(keys).alias("r")).select("fp", "r.m", "r.k")
    sizes = routed.groupBy("m", "k").agg(F.count("*").alias("n")).filter("n > 1")
    chunk = F.pmod(F.xxhash64("fp"), F.col("g"))
    g = F.ceil(F.col("n") / F.lit(tile))
    met = routed.join(sizes, ["m", "k"]).withColumn("g", g).withColumn("c", chunk)
    # Chunk c meets every chunk: as the left one in (c, j) and as the right one in (i, c).
    others = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1),
        lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j"), (F.col("c") > j).alias("right")),
    )
    tiles = met.select("fp", "m", "k", F.explode(others).alias("t")).select("fp", "m", "k", "t.i", "t.j", "t.right")
    key = F.xxhash64("m", "k", "i", "j")
    tiles = tiles.select("fp", "right", (F.col("i") != F.col("j")).alias("two"), "m", "k", "i", "j", key.alias("h"))
    sorted_tiles = tiles.repartition("h").sortWithinPartitions("h", "m", "k", "i", "j")
    refs = pivots()

    def run(batches):
        def solve(fp, right, two):
            if two:
                return _tile_links(fp[~right], fp[right], radius, refs)
            return _tile_links(fp, None, radius, refs)

        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                fp = b.column(0).to_numpy().view(np.uint64)
                flags = [b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)]
                ids = [b.column(c).to_numpy() for c in (3, 4, 5, 6)]
                now = [fp, *flags, *ids]
                held = now if held is None else [np.concatenate(z) for z in zip(held, now, strict=True)]
            if held is None or not len(held[0]):
                continue
            change = np.zeros(len(held[0]) - 1, bool)
            for z in held[3:]:
                change |= z[1:] != z[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(held[0])]])
            if b is not None:  # the last tile may go on in the next batch
                cuts = cuts[:-1]
            us, vs = [], []
            for s, e in itertools.pairwise(cuts.tolist()):
                if e - s > 1:
                    u, v = solve(held[0][s:e], held[1][s:e], held[2][s])
                    us.append(u)
                    vs.append(v)
            held = [z[cuts[-1] :] for z in held]
            if us:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(us).view(np.int64)), pa.array(np.concatenate(vs).view(np.int64))], names=["u", "v"]
                )

    return sorted_tiles.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges``; connected nodes have the same root.

    Rounds of contraction: each node hooks to its smallest neighbour, edges move to the
    hooked ends, and loops and repeats go. Values are hashes, so the nodes left fall by
    a constant factor a round. Every round is a written table.
    """
    spark = edges.sparkSession
    edges, where_e = new_stage(edges, "edges")
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    roots = both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    where_r = None
    while not edges.isEmpty():
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to"))
        hook, where_h = new_stage(hook, "hooks")
        # One jump along the hooks halves chains.
        far = hook.alias("a").join(hook.alias("b"), F.col("a.to") == F.col("b.u")).select(
            F.col("a.u").alias("n"), F.col("b.to").alias("to")
        )
        far, where_f = new_stage(far, "jumps")
        left = edges.join(far, edges.u == far.n).select(F.col("to").alias("a"), "v")
        right = left.join(far, left.v == far.n).select("a", F.col("to").alias("b"))
        contracted = right.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        moved = roots.join(far, roots.root == far.n, "left").select("node", F.coalesce("to", "root").alias("root"))
        moved, where_m = new_stage(moved, "roots")
        contracted, where_c = new_stage(contracted, "edges")
        for old in (where_e, where_h, where_f, where_r):
            if old:
                remove_folder(spark, old)
        edges, roots, where_e, where_r = contracted, moved, where_c, where_m
    return roots


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    Equal fingerprints are one class; only classes are compared, and copies are never
    expanded into pairs. ``component_id`` is the smallest id reachable over links; null
    ids are passed over unless a group has no other. Null, empty and blank texts have
    fingerprint zero, which links like any other. Repeated rows stay. An empty table
    gives an empty result.
    """
    prints, _ = new_stage(fingerprints(docs, shingle_words, id_column, text), "fingerprints")
    classes, where = new_stage(prints.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    roots = components(links(classes, classes.count(), radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = rooted.join(lowest, "root").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(of_class, prints.fp == F.col("__fp")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
