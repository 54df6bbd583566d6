"""Best-fit packing of documents into fixed-length sequences, certified by lower bounds."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import new_stage, remove_folder
from ledgerloom.llm.tokens import END_ID, tokenizer

CAPACITY = 1024
GROUP_PIECES = 16_384

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = PIECES + ", sequence_id long, offset long, exchange boolean"


def dual_feasible(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of dual feasible functions for the sizes 0..capacity, and the value of a full bin.

    Three families: sizes below a cut vanish and those above its complement fill a bin;
    sizes rounded down on a grid of k + 1; sizes counted in multiples of a unit, large
    ones from above. Any packing's bins are at least the summed values over the unit.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    rows, units = [x], [capacity]
    for cut in range(1, capacity // 2 + 1):
        rows.append(np.where(x > capacity - cut, capacity, np.where(x < cut, 0, x)))
        units.append(capacity)
    for k in range(1, min(128, capacity)):
        scaled = (k + 1) * x
        rows.append(np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity))
        units.append(k * capacity)
    for unit in range(1, capacity // 2 + 1):
        whole = capacity // unit
        large, half = 2 * (whole - (capacity - x) // unit), 2 * x == capacity
        rows.append(np.where(half, whole, np.where(2 * x > capacity, large, 2 * (x // unit))))
        units.append(2 * whole)
    return np.array(rows), np.array(units)


def lower_bound(lengths: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> int:
    """No packing of ``lengths`` has fewer bins."""
    values, units = functions
    counts = np.bincount(lengths, minlength=values.shape[1])
    return int(np.max(-(-(values @ counts) // units)))


def best_fit_decreasing(lengths: Iterable[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, given in falling order, and the room left per bin.

    Open bins are kept by remaining room; one integer has a bit for each room that
    occurs, so the tightest fitting bin is its lowest bit at or above the length.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, where, offsets, left = 0, [], [], []
    for n in lengths:
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(left), capacity
            left.append(capacity)
        where.append(b)
        offsets.append(capacity - room)
        rest = room - n
        left[b] = rest
        if rest:
            by_room[rest].append(b)
            rooms |= 1 << rest
    return np.array(where, np.int64), np.array(offsets, np.int64), np.array(left, np.int64)


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Documents as token pieces of at most ``capacity``; only longer ones are cut.

    The first piece of a cut document may be the shorter one. A null or empty text is the
    single token ``end_id``.
    """

    def run(batches):
        tok, last = tokenizer(vocabulary), np.uint32(end_id).astype("<u4").tobytes()
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                out = []
                for doc, ids in zip(part.column(0).to_pylist(), tok.encode(part.column(1).to_pylist()), strict=True):
                    ids += last
                    step = 4 * capacity
                    first = len(ids) % step or step  # the remainder leads
                    for k, a in enumerate([0, *range(first, len(ids), step)]):
                        cut = ids[a : a + step] if k else ids[:first]
                        out.append((doc, k, a // 4, len(cut) // 4, zlib.crc32(cut)))
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, PIECES)


def _pack(pieces: DataFrame, count: int, stage: int, capacity: int, group_pieces: int) -> DataFrame:
    """One round: partitions of about ``group_pieces`` pieces, each packed and certified."""
    groups = max(1, -(-count // group_pieces))
    functions = pieces.sparkSession.sparkContext.broadcast(dual_feasible(capacity))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        where, offsets, left = best_fit_decreasing(lengths.tolist(), capacity)
        # A certified partition keeps its bins but for the emptiest; one with a gap
        # exchanges the documents of all its bins with room.
        if len(left) == lower_bound(lengths, functions.value):
            open_bins = np.zeros(len(left), bool)
            open_bins[np.argmax(left)] = left.max() > 0
        else:
            open_bins = left > 0
        return pdf.assign(
            sequence_id=(np.int64(stage) << 48) | (np.int64(key[0]) << 20) | where, offset=offsets, exchange=open_bins[where]
        )[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "exchange"]]

    # The round enters the hash, so that pieces meet others than before.
    # The row number spreads repeated rows.
    group = F.pmod(F.xxhash64("__r", F.lit(stage)), F.lit(groups)).alias("__g")
    salted = pieces.withColumn("__r", F.monotonically_increasing_id())
    return salted.groupBy(group).applyInPandas(run, _PLACED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Places pieces into as few sequences of ``capacity`` tokens as the rounds find.

    ``pieces``: doc_id, piece, start, length (1..capacity), ids_crc32; repeated rows are
    separate pieces, null ids are allowed. Adds sequence_id and a gapless offset.

    Each round spreads the open pieces over partitions of bounded size, packs each
    best-fit decreasing, and holds its bin count against dual-feasible lower bounds.
    Partitions with a gap exchange documents in the next round; it ends when a round
    saves no sequence. No bin is lost: a round that would need more bins is not taken.
    An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    done: DataFrame | None = None
    current, count, bins, before = pieces, pieces.count(), None, None
    for stage in itertools.count():
        placed, where = new_stage(_pack(current, count, stage, capacity, group_pieces), f"packed-{stage}")
        now = placed.agg(F.count_distinct("sequence_id")).first()[0]
        if bins is not None and now >= bins:
            remove_folder(spark, where)
            break
        kept = placed.filter(~F.col("exchange"))
        if before is not None:
            done = before if done is None else done.unionByName(before)
        before, current = kept, placed.filter("exchange")
        last = current
        totals = current.agg(F.count("*").alias("n"), F.count_distinct("sequence_id").alias("b")).first()
        count, bins = totals.n, totals.b
        if bins <= 1:
            break
    columns = [c.split()[0] for c in _PLACED.split(", ")][:-1]
    result = before.unionByName(last)
    return (result if done is None else done.unionByName(result)).select(*columns)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, **columns) -> DataFrame:
    """Tokenises, cuts and packs whole documents.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts count
    as empty, null ids and repeated rows are packed like any other, further columns are
    ignored, an empty table gives no rows.
    """
    pieces, _ = new_stage(token_pieces(docs, vocabulary, capacity, end_id, **columns), "pieces")
    return pack(pieces, capacity, group_pieces)
