"""Incremental ingest as a stream, of statement files or of standard transactions."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import standardize
from ledgerloom.plans.booking import Books, late_rows
from ledgerloom.plans.jobs import PENDING, PROCESSED, Rules, pending_files
from ledgerloom.schema import TXN
from ledgerloom.sources.ledger import LedgerStore
from ledgerloom.sources.statements import explode_records, plain_path

__all__ = ["ingest_stream", "late_rows", "read_statement_stream", "statement_stream"]

PARSED = T.StructType([T.StructField("file_id", T.StringType()), *TXN.fields])
FILES_PER_TRIGGER = 1000


def read_statement_stream(spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """T7 source: each ``.csv`` file of a folder as one row, at most so many files a batch."""
    return (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
        .select("value", plain_path(F.col("_metadata.file_path")).alias("file_id"), F.col("_metadata.file_name").alias("file_name"))
    )


def _keep_late(books: Books, parsed: DataFrame, batch_id: int) -> None:
    late = late_rows(parsed, books.watermark()).withColumn("batch", F.lit(batch_id))
    books.store.put_partitions("late", late.select("file_id", *TXN.fieldNames(), "batch"), ["batch"])


def statement_stream(
    files: DataFrame, store: LedgerStore, checkpoint: str, rules: Rules, as_of: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Statement files in, deduplicated and categorised ledger rows out.

    ``files``: the stream of ``read_statement_stream``. Each batch runs C1-C7 over its file
    names before a content is split, then A1-A16, the late-data rule, D3-D5, K14 and the
    booking. Work follows the batch: the ledger is read in the batch's months only, the
    index and the watermarks are stored and grow by the batch. Rows that come late are kept
    in the table ``late``, one partition a batch. A batch cut short anywhere is finished or
    repeated with the same result; one booked already adds nothing.

    ``as_of`` bounds future dates (today when unset); ``trigger`` defaults to ``availableNow``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        books = Books(store).open()
        processed = store.read("processed", PROCESSED)
        pending = pending_files(batch.select("file_id", "file_name"), rules, books.watermark(), processed)
        pending = store.rewrite("pending", pending.select(*PENDING.fieldNames()))
        rows = explode_records(batch.join(pending.select("file_id").distinct(), "file_id", "left_semi"))
        day = as_of or datetime.date.today().isoformat()
        parsed = standardize.accepted(standardize.parse_statements(rows, pending, rules.configs, day))
        parsed = store.rewrite("parsed", parsed.select(*PARSED.fieldNames()))
        _keep_late(books, parsed, batch_id)
        booked = books.ingest(parsed, rules.matchers, rules.ignore)
        rules.mirror_rows(store, booked)

    return _start(files, apply, checkpoint, trigger)


def ingest_stream(
    transactions: DataFrame, store: LedgerStore, checkpoint: str, matchers: Sequence[dict],
    ignore: Sequence[dict] = (), trigger: dict | None = None,
) -> StreamingQuery:
    """T7 for standard transactions that come without files.

    ``transactions``: a stream of txn_date, account, description, amount. Late rows go to
    the table ``late``, rows the ledger holds go, the rest is categorised and booked.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        books = Books(store).open()
        rows = standardize.conform(batch).withColumn("file_id", F.lit(None).cast("string"))
        parsed = store.rewrite("parsed", rows.select(*PARSED.fieldNames()))
        _keep_late(books, parsed, batch_id)
        books.ingest(parsed, matchers, ignore)

    return _start(transactions, apply, checkpoint, trigger)


def _start(stream: DataFrame, apply, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
