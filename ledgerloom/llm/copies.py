"""Near copies by SimHash with pivot tables, verified by exact shingle similarity.

Texts are sets of five-word shingles, and equal sets are one class. Fingerprints have 256
bits, so that their distance tells a similarity of 0.8 (39 bits, with a deviation of 6)
from texts that share a passage (100 bits). That is too many for blocks of bits to route
them, so the smallest shingle hashes of a class route it: of the ``KEYS`` smallest hashes of two
sets' union each lies in both sets with the pair's similarity, so the pair misses every
common key with probability 0.2 ** KEYS. Within a key, pivot distance tables and the
fingerprints themselves discard pairs; what is left is not named pair by pair but joined to
candidate groups. A group's texts then meet, and its survivors are verified exactly there.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Words, mix, new_stage, remove_folder
from ledgerloom.llm.simhash import _Forest, components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
KEYS = 24
WORDS = 4  # of 64 bits in a fingerprint
RADIUS = 68  # bits; five deviations above the distance at the threshold
SHORT_RADIUS = 104  # for pairs with a set of fewer than KEYS shingles, whose bits are decided by few votes
PIVOTS = 4
TILE = 4096
HOT_SHARE = 10_000  # a key in more than one of so many classes, and more than a tile, is common
TILE_SHINGLES = 4 << 20
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False


def _blank_split(texts: list[str | None]) -> Words:
    """Blank-separated words of each text, A-Z lower-cased, as op4 reads them."""
    encoded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    edges = np.diff(_NOT_BLANK[data].view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    bounds = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])]).astype(np.int64)
    return Words(data, start, end, np.searchsorted(start, bounds))


def shingle_sets(texts: list[str | None], shingle_words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words are one shingle."""
    words = _blank_split(texts)
    hashes, out = words.hashes(), []
    for a, e in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = min(shingle_words, e - a)
        total = np.full(max(0, e - a - n + 1) if n else 0, n, np.uint64)
        for k in range(n):
            total = mix(total * np.uint64(31) + hashes[a + k : e - n + 1 + k] + np.uint64(k + 1))
        out.append(np.unique(total))
    return out


def _class_of(own: np.ndarray) -> int:
    """64-bit hash of a shingle set; 0 for the empty one."""
    if not len(own):
        return 0
    at = np.arange(1, len(own) + 1, dtype=np.uint64)
    folded = np.bitwise_xor.reduce(mix(own + mix(at))) + np.uint64(len(own))
    return int(mix(np.array([folded]))[0].view(np.int64))


def simhash(own: np.ndarray) -> bytes:
    """Fingerprint of a shingle set: each bit by the majority of the hashes, of four mixes of them."""
    out = []
    for word in range(WORDS):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(own), 8192):
            h = own[i : i + 8192]
            h = mix(h + np.uint64(word)) if word else h
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(own), bitorder="little").tobytes())
    return b"".join(out)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each fingerprint of ``a`` and each of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for word in range(WORDS):
        out += np.bitwise_count(a[:, word][:, None] ^ b[:, word][None, :])
    return out


SKETCH = "row long, cls long, n int, fp binary, keys array<long>"


def sketches(rows: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(row, cls, n, fp, keys): class, size, fingerprint and smallest hashes of each text."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = shingle_sets(part.column(1).to_pylist(), shingle_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([simhash(s) for s in sets], pa.binary()), pa.array([s[:KEYS].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["row", "cls", "n", "fp", "keys"],
                )

    return rows.select("row", "text").mapInArrow(run, SKETCH)


def references(fp: np.ndarray) -> np.ndarray:
    """Reference fingerprints of a tile, each far from those before it.

    Distances of random references to any text are about half of the bits, and tell nothing;
    one out of a cluster of copies is near to these and far from the rest.
    """
    at, near = [0], distances(fp, fp[:1])[:, 0]
    while len(at) < PIVOTS:
        at.append(int(near.argmax()))
        near = np.minimum(near, distances(fp, fp[at[-1:]])[:, 0])
    return fp[at]


def near_pairs(fp: np.ndarray, n: np.ndarray, right: np.ndarray | None, radius: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one tile (or between its two sides) within the radius.

    A table holds the distances to the reference fingerprints; where two rows of it differ
    by more than the radius in a column, so do the fingerprints.
    """
    own = radius
    radius = max(radius, SHORT_RADIUS) if (n < KEYS).any() else radius
    table = distances(fp, references(fp)).astype(np.int16)
    left_at = np.arange(len(fp)) if right is None else np.flatnonzero(~right)
    right_at = left_at if right is None else np.flatnonzero(right)
    right_at = right_at[np.argsort(table[right_at, 0], kind="stable")]
    left_at = left_at[np.argsort(table[left_at, 0], kind="stable")]
    first = table[right_at, 0]
    for i in range(0, len(left_at), 256):
        x = left_at[i : i + 256]
        lo = np.searchsorted(first, int(table[x[0], 0]) - radius, "left")
        hi = np.searchsorted(first, int(table[x[-1], 0]) + radius, "right")
        y = right_at[lo:hi]
        keep = np.ones((len(x), len(y)), bool)
        for c in range(PIVOTS):
            keep &= np.abs(table[x, c][:, None] - table[y, c][None, :]) <= radius
        a, b = np.nonzero(keep)
        a, b = x[a], y[b]
        if right is None:
            a, b = a[a < b], b[a < b]
        apart = np.zeros(len(a), np.uint16)
        for word in range(WORDS):
            apart += np.bitwise_count(fp[a, word] ^ fp[b, word])
        fits = (n[a] >= threshold * n[b] - 1e-9) & (n[b] >= threshold * n[a] - 1e-9)
        fits &= apart <= np.where(np.minimum(n[a], n[b]) < KEYS, radius, own)
        yield a[fits], b[fits]


def _tiled(routed: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """Rows (*by, i, j, right and those of ``classes``) of the classes that share the ``by`` of ``routed``.

    The classes of a key are cut into chunks of about ``TILE`` and of bounded size; each
    pair of chunks is a tile, so that a common key is many small tasks. Keys are met by
    class numbers alone; the rest joins where a key has partners.
    """
    sizes = routed.groupBy(*by).agg(F.count("*").alias("members"), F.sum("n").alias("w")).filter("members > 1")
    sizes = sizes.select(*by, F.ceil(F.greatest(F.col("members") / TILE, F.col("w") / TILE_SHINGLES)).alias("g"))
    met = routed.drop("n").join(sizes, by).withColumn("c", F.pmod(F.xxhash64("cls"), F.col("g")))
    # Chunk c meets every chunk: as the left one in (c, j) and as the right one in (i, c).
    others = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1),
        lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j"), (F.col("c") > j).alias("right")),
    )
    out = met.select("cls", *by, F.explode(others).alias("t")).select("cls", *by, "t.i", "t.j", "t.right")
    return out.join(classes, "cls").select(*by, "i", "j", "right", *classes.columns)


def _tile_of(t: pa.Table) -> tuple[np.ndarray, ...]:
    """(cls, n, fp, right) of a tile; ``right`` is None where its two chunks are one."""
    cls, n = t.column("cls").to_numpy(), t.column("n").to_numpy()
    fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), "<u8").reshape(-1, WORDS)
    right = t.column("right").to_numpy() if t.column("i")[0] != t.column("j")[0] else None
    return cls, n, fp, right


def _by_tile(rows: DataFrame, tile: list[str], solve: Callable[[pa.Table], pa.RecordBatch], schema: str, *order: str) -> DataFrame:
    """Applies ``solve`` to the rows of each tile; a task holds one tile at a time."""
    placed = rows.repartition(*tile).sortWithinPartitions(*tile, *order)
    at = [rows.columns.index(c) for c in tile]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in itertools.chain(batches, [None]):
            if b is None:
                if held:
                    yield solve(pa.Table.from_batches(held))
                break
            if not b.num_rows:
                continue
            columns = [b.column(c).to_numpy(zero_copy_only=False) for c in at]
            change = np.zeros(b.num_rows - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [b.num_rows]]).tolist()
            if held and any(held[-1].column(c)[held[-1].num_rows - 1] != b.column(c)[0] for c in at):
                yield solve(pa.Table.from_batches(held))
                held = []
            for s, e in itertools.pairwise(cuts):
                held.append(b.slice(s, e - s))
                if e < b.num_rows:
                    yield solve(pa.Table.from_batches(held))
                    held = []

    return placed.mapInArrow(run, schema)


def _forest_batch(cls: np.ndarray, forest: _Forest) -> pa.RecordBatch:
    """One edge for each class of a tile that is joined to another."""
    member = np.flatnonzero(forest.label != np.arange(len(cls)))
    u, v = cls[member], cls[forest.label[member]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _candidate_links(classes: DataFrame, radius: int, threshold: float) -> DataFrame:
    """Edges (u, v) that connect the classes whose fingerprints pass in a tile: a forest of each tile."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        cls, n, fp, right = _tile_of(t)
        forest = _Forest(len(cls))
        for a, b in near_pairs(fp, n, right, radius, threshold):
            forest.link(a, b)
        return _forest_batch(cls, forest)

    routed = classes.select("cls", "n", F.explode("keys").alias("k"))
    tiles = _tiled(routed, classes.select("cls", "n", "fp"), ["k"])
    return _by_tile(tiles, ["k", "i", "j"], solve, "u long, v long", "cls").distinct()


def _verified_links(members: DataFrame, radius: int, threshold: float, shingle_words: int) -> DataFrame:
    """Edges (u, v) that connect the classes of each candidate group by exact similarity.

    ``members(cls, n, fp, keys, root, t)``. A group that fits a tile meets as a whole, so
    each of its texts is sent once; the classes of a larger one meet over their keys. Within
    a tile survivors are compared by their whole sets, unless they are joined already, and
    a forest is returned, so that no row is made for a pair.
    """

    def solve(t: pa.Table) -> pa.RecordBatch:
        cls, n, fp, right = _tile_of(t)
        forest = _Forest(len(cls))
        sets = shingle_sets(t.column("t").to_pylist(), shingle_words)
        held, ids = np.unique(np.concatenate(sets), return_inverse=True)
        sets = np.split(ids, np.cumsum([len(s) for s in sets])[:-1])
        size, mark = np.array([len(s) for s in sets]), np.zeros(len(held), bool)
        for a, b in near_pairs(fp, n, right, radius, threshold):
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            for s, e in itertools.pairwise(np.flatnonzero(np.diff(a, prepend=-1, append=-1)).tolist()):
                x, y = a[s], b[s:e]
                y = y[forest.label[y] != forest.label[x]]
                if not len(y):
                    continue
                mark[sets[x]] = True
                starts = np.concatenate([[0], np.cumsum(size[y])[:-1]])
                both = np.add.reduceat(mark[np.concatenate([sets[i] for i in y])], starts, dtype=np.int64)
                mark[sets[x]] = False
                y = y[both >= threshold * (size[x] + size[y] - both) - 1e-9]
                forest.link(np.full(len(y), x), y)
        return _forest_batch(cls, forest)

    weight = members.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("w"))
    whole = weight.select("root", ((F.col("members") <= TILE) & (F.col("w") <= TILE_SHINGLES)).alias("whole"))
    keys = F.when(F.col("whole"), F.array(F.lit(0).cast("bigint"))).otherwise(F.col("keys"))
    routed = members.select("cls", "n", "keys", "root").join(whole, "root").select("root", "cls", "n", F.explode(keys).alias("k"))
    tiles = _tiled(routed, members.select("cls", "n", "fp", "t"), ["root", "k"])
    return _by_tile(tiles, ["root", "k", "i", "j"], solve, "u long, v long", "cls").distinct()


def near_copies(rows: DataFrame, threshold: float = THRESHOLD, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(row, root) per row of ``rows`` (row long, text string); near copies share a root.

    Links are the pairs whose sets of ``shingle_words``-word shingles have a Jaccard
    similarity of at least ``threshold`` and whose fingerprints lie within ``radius`` bits
    (``SHORT_RADIUS`` for short texts);
    groups are the connected components. Texts of equal sets are one class; null, empty and
    blank texts are one class of their own. Repeated rows stay, other columns are ignored,
    an empty table gives an empty result.

    A key found in very many classes, such as a shingle of a common passage, routes only
    classes most of whose keys are common; others meet over their own keys. Classes that pass
    the fingerprint test are joined to candidate groups by forests, whose rows follow the
    classes and not their pairs; exact verification happens within these groups.
    """
    spark, folders = rows.sparkSession, []

    def stage(df: DataFrame, purpose: str) -> DataFrame:
        table, where = new_stage(df, purpose)
        folders.append(where)
        return table

    sketched = stage(sketches(rows, shingle_words), "copy-sketches")
    one = F.min_by(F.struct("row", "n", "fp", "keys"), "row").alias("s")
    classes = sketched.filter("cls <> 0").groupBy("cls").agg(one).select("cls", "s.*")
    classes = stage(classes, "copy-classes")
    most = max(TILE, classes.count() // HOT_SHARE)
    counted = classes.select(F.explode("keys").alias("k")).groupBy("k").count().filter(F.col("count") > most)
    hot = np.sort(counted.select("k").toArrow().column("k").to_numpy())  # at most KEYS * HOT_SHARE keys
    if len(hot):
        classes = stage(_own_keys(classes, hot), "copy-routes")
    met = _groups(stage(_candidate_links(classes, radius, threshold), "copy-candidates"))
    members = classes.join(met, "cls").join(rows.select("row", F.col("text").alias("t")), "row").drop("row")
    members = stage(members, "copy-members")
    named = _groups(stage(_verified_links(members, radius, threshold, shingle_words), "copy-links"))
    result, _ = new_stage(sketched.join(named, "cls", "left").select("row", F.coalesce("root", "cls").alias("root")), "copy-roots")
    for where in folders:
        remove_folder(spark, where)
    return result


def _own_keys(classes: DataFrame, hot: np.ndarray) -> DataFrame:
    """Classes with at least half of their keys uncommon keep only those."""
    held = classes.sparkSession.sparkContext.broadcast(hot)
    at = classes.columns.index("keys")

    def run(batches):
        for b in batches:
            keys = []
            for own in b.column(at).to_pylist():
                own = np.array(own, np.int64)
                place = np.minimum(np.searchsorted(held.value, own), len(held.value) - 1)
                rare = own[held.value[place] != own]
                keys.append(rare if 2 * len(rare) >= len(own) else own)
            yield b.set_column(at, "keys", pa.array(keys, pa.list_(pa.int64())))

    return classes.mapInArrow(run, classes.schema)


def _groups(edges: DataFrame) -> DataFrame:
    """(cls, root) of the classes in any edge."""
    return components(edges).select(F.col("node").alias("cls"), "root")
