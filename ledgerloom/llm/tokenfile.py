"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A file is a sequence of blocks, each followed by one line feed. A block is

    magic ``TIDB``, then unsigned 32-bit: part, documents, tokens, control bytes, data
    bytes; unsigned 64-bit: tokens of the part before this block;
    per document: a null flag byte, the id (signed 64-bit), the token count (unsigned 32-bit);
    control bytes: two bits per token, the byte length of its rank less one;
    data bytes: the ranks, little-endian, without leading zero bytes;
    CRC-32 of all of the above, unsigned 32-bit.

All numbers are little-endian. Ranks number the ids by falling corpus frequency (ties:
smaller id first); the rank table and the start of each part lie beside the files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import new_stage, remove_folder, shared_folder
from ledgerloom.llm.tokens import END_ID, tokenizer

MAGIC = b"TIDB"
HEAD = "<4sIIIIIQ"
HEAD_BYTES = struct.calcsize(HEAD)
BLOCK_TOKENS = 1 << 16
FILE_TOKENS = 6_000_000

# Per control byte: the lengths of its four ranks, their offsets and their total.
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
_OFFSETS = np.cumsum(_LENGTHS, axis=1) - _LENGTHS
_TOTALS = _LENGTHS.sum(axis=1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    more = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        more[: len(ranks)] += ranks > limit
    control = more[0::4] | more[1::4] << 2 | more[2::4] << 4 | more[3::4] << 6
    more = more[: len(ranks)]
    ends = np.cumsum(more + np.int64(1))
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    begins = ends - more - 1
    data[begins] = ranks & 0xFF
    for k in range(1, 4):
        longer = np.flatnonzero(more >= k)
        if not len(longer):
            break
        data[begins[longer] + k] = ranks[longer] >> (8 * k) & 0xFF
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Inverse of ``encode_ranks``: lengths and offsets by table lookup, four ranks a control byte."""
    codes, data = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)
    lengths = _LENGTHS[codes]
    totals = _TOTALS[codes]
    begins = ((np.cumsum(totals) - totals)[:, None] + _OFFSETS[codes]).reshape(-1)[:n]
    lengths = lengths.reshape(-1)[:n]
    ranks = data[begins].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        ranks[longer] |= data[begins[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def pack_block(part: int, start: int, ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    body = b"".join(
        [
            struct.pack(HEAD, MAGIC, part, len(ids), len(ranks), len(control), len(data), start),
            bytes(i is None for i in ids),
            np.array([i or 0 for i in ids], "<i8").tobytes(),
            np.array(counts, "<u4").tobytes(),
            control,
            data,
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def blocks_of(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(part, start, document ids, counts, ranks) of each block of a file."""
    at, view = 0, memoryview(content)
    while at < len(content):
        magic, part, n, tokens, n_control, n_data, start = struct.unpack_from(HEAD, view, at)
        size = HEAD_BYTES + 13 * n + n_control + n_data
        if magic != MAGIC or zlib.crc32(view[at : at + size]) != struct.unpack_from("<I", view, at + size)[0]:
            raise ValueError(f"damaged token block at byte {at}")
        p = at + HEAD_BYTES
        nulls = view[p : p + n]
        ids = np.frombuffer(view[p + n : p + 9 * n], "<i8").tolist()
        counts = np.frombuffer(view[p + 9 * n : p + 13 * n], "<u4")
        p += 13 * n
        yield part, start, [None if z else i for z, i in zip(nulls, ids, strict=True)], counts, decode_ranks(
            bytes(view[p : p + n_control]), bytes(view[p + n_control : p + n_control + n_data]), tokens
        )
        at += size + 5  # checksum and line feed


def id_width(vocabulary: str, end_id: int) -> int:
    """Bytes per id that the vocabulary needs."""
    return 2 if max(tokenizer(vocabulary).size, end_id + 1) <= 1 << 16 else 4


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, id_column: str, text: str) -> DataFrame:
    """(id, tie, n, ids) per row; ids as 16-bit values where the vocabulary allows."""
    small = id_width(vocabulary, end_id) == 2

    def run(batches):
        tok, last = tokenizer(vocabulary), struct.pack("<I", end_id)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids = [x + last for x in tok.encode(part.column(1).to_pylist())]
                sizes = [len(x) // 4 for x in ids]
                if small:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "tie", "n", "ids"],
                )

    i, t = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text}`")
    rows = docs.select(i.alias("id"), t.alias("t"), F.xxhash64(t).alias("tie"))
    return rows.mapInArrow(run, "id long, tie long, n long, ids binary")


def _flat(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column in one array, and the ids per row."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    ids = np.frombuffer(data, f"<u{width}", (offsets[-1] - offsets[0]) // width, offsets[0]) if len(column) else np.zeros(0, f"<u{width}")
    return ids, np.diff(offsets) // width


def _frequencies(tokens: DataFrame, width: int) -> np.ndarray:
    """Count of every id over all documents; the result has one row per vocabulary id."""

    def run(batches):
        total = np.zeros(1, np.int64)
        for b in batches:
            c = np.bincount(_flat(b.column(0), width)[0])
            if len(c) > len(total):
                c[: len(total)] += total
                total = c
            else:
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["t", "c"])

    rows = tokens.select("ids").mapInArrow(run, "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(1 + max((r.t for r in rows), default=0), np.int64)
    for r in rows:
        counts[r.t] = r.c
    return counts


def write_token_files(
    docs: DataFrame, vocabulary: str, where: str, end_id: int = END_ID, id_column: str = "doc_id", text: str = "text"
) -> None:
    """Writes the ids of all documents, in ascending id order, to files below ``where``.

    Each row is one document: its text's ids and ``end_id``. A null text counts as empty;
    null ids come first; rows of equal id are ordered by a hash of the text. An empty
    table gives no blocks. Three tables are written: ``files`` (the blocks), ``ranks``
    (rank, id) and ``parts`` (part, start).

    Every text is encoded once; the compact ids are a written table, counted, then range
    partitioned by document id, ranked and coded.
    """
    spark, width = docs.sparkSession, id_width(vocabulary, end_id)
    tokens, scratch = new_stage(tokenize(docs, vocabulary, end_id, id_column, text), "tokens")
    counts = _frequencies(tokens, width)
    order = np.lexsort((np.arange(len(counts)), -counts))  # id of each rank; one entry per vocabulary id
    rank_of = np.empty(len(order), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    table = spark.sparkContext.broadcast(rank_of)

    def run(batches):
        part, start, ids, sizes, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block():
            packed = pack_block(part, start, ids, sizes, np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["block"])

        for b in batches:
            flat, lengths = _flat(b.column(1), width)
            ranks, ends = table.value[flat], np.cumsum(lengths)
            numbers, lengths, first = b.column(0).to_pylist(), lengths.tolist(), 0
            for row, n in enumerate(lengths):
                if size and size + n > BLOCK_TOKENS:
                    if row > first:
                        held.append(ranks[ends[first] - lengths[first] : ends[row - 1]])
                    yield block()
                    start, ids, sizes, held, size, first = start + size, [], [], [], 0, row
                ids.append(numbers[row])
                sizes.append(n)
                size += n
            if lengths:
                held.append(ranks[ends[first] - lengths[first] :])
        if ids:
            yield block()

    total = int(counts.sum())
    parts = max(1, -(-total // FILE_TOKENS))
    # Equal rows are interchangeable, so a row number may split a repeated id over parts.
    ranged = tokens.select("id", "ids", "tie", F.monotonically_increasing_id().alias("row"))
    ranged = ranged.repartitionByRange(parts, F.asc_nulls_first("id"), "tie", "row")
    ordered = ranged.sortWithinPartitions(F.asc_nulls_first("id"), "tie", "row").select("id", "ids")
    blocks = ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.text(f"{where}/files")
    remove_folder(spark, scratch)
    spark.createDataFrame(
        pa.table({"rank": pa.array(range(len(order)), pa.int64()), "id": pa.array(order, pa.int64())})
    ).coalesce(1).write.parquet(f"{where}/ranks")
    read = spark.read.format("binaryFile").load(f"{where}/files").select("content")

    def heads(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                sizes: dict[int, int] = {}
                at = 0
                while at < len(content):
                    _, part, n, tokens_, n_control, n_data, _ = struct.unpack_from(HEAD, content, at)
                    sizes[part] = sizes.get(part, 0) + tokens_
                    at += HEAD_BYTES + 13 * n + n_control + n_data + 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sizes.keys(), pa.int64()), pa.array(sizes.values(), pa.int64())], names=["part", "n"]
                )

    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = read.mapInArrow(heads, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{where}/parts")


def read_token_files(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document of the files below ``where``."""
    rows = spark.read.schema("rank long, id long").parquet(f"{where}/ranks").orderBy("rank").collect()  # vocabulary size
    table = spark.sparkContext.broadcast(np.array([r.id for r in rows], "<u4"))
    schema = "part long, doc_id long, local long, n_tokens long, ids_crc32 long"

    def run(batches):
        for b in batches:
            for content in b.column(0):
                for part, start, ids, counts, ranks in blocks_of(content.as_py()):
                    tokens = table.value[ranks]
                    ends = np.cumsum(counts, dtype=np.int64)
                    begins = ends - counts
                    crc = [zlib.crc32(tokens[a:e].tobytes()) for a, e in zip(begins, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * len(ids), pa.int64()),
                            pa.array(ids, pa.int64()),
                            pa.array(begins + start, pa.int64()),
                            pa.array(counts.astype(np.int64)),
                            pa.array(crc, pa.int64()),
                        ],
                        names=["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").load(f"{where}/files").select("content")
    parts = spark.read.schema("part long, base long").parquet(f"{where}/parts")
    return (
        files.mapInArrow(run, schema)
        .join(parts, "part")
        .select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "token-files")
