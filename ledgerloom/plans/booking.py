"""Booking of labelled batches: each one once into ledgers, category index and watermarks.

A batch is first written and published as a table of its own; only then is it booked. If
the booking is cut short, the next one begins by finishing it, with the rows the ledgers
lack. What is derived from the ledgers (the index, the newest day of each account) follows
the batches; it is built anew only where a ledger was rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import dedup, guard, standardize
from ledgerloom.operators.categorize import apply_predictions, categorize, merge_cache, vocabulary
from ledgerloom.operators.index_store import IndexStore
from ledgerloom.operators.category_index import query_keys
from ledgerloom.schema import TXN, TXN_COLUMNS
from ledgerloom.sources.ledger import LedgerStore

KINDS = ("bank", "cc")
BATCH = T.StructType([*TXN.fields, T.StructField("source", T.StringType())])
WATERMARK = T.StructType([T.StructField("account", T.StringType()), T.StructField("latest", T.DateType())])
REWRITTEN = T.StructType([T.StructField("rewritten", T.LongType())])
STATE = T.StructType([T.StructField(c, T.LongType()) for c in ("booked", *KINDS)])
LABEL_CACHE = T.StructType(
    [
        T.StructField("norm", T.StringType()),
        T.StructField("is_debit", T.BooleanType()),
        T.StructField("category", T.StringType()),
    ]
)


class Books:
    """Ledgers of a store with what is derived from them."""

    def __init__(self, store: LedgerStore) -> None:
        self.store, self.index = store, IndexStore(store, "index", "ledgers")

    # -- state -----------------------------------------------------------------
    def _ledger_generations(self) -> list[int]:
        return [self.store.generation(f"ledger-{k}") for k in KINDS]

    def _save_state(self, booked: int) -> None:
        row = (booked, *self._ledger_generations())
        self.store.replace("books", self.store.spark.createDataFrame([row], STATE))

    def open(self) -> Books:
        """Finishes a batch whose booking was cut short; rebuilds after a ledger's rewrite."""
        self._finish_rewrite()
        state = self.store.read("books", STATE).first()
        staged = self.store.generation("batch")
        if state is not None and state.booked < staged:
            self._book(staged, repeated=True)
            state = self.store.read("books", STATE).first()
        if state is None or [state[k] for k in KINDS] != self._ledger_generations() or not self.index.exists():
            self.rebuild()
        return self

    def rewrite(self, labelled: DataFrame) -> dict[str, int]:
        """L6 for the months of ``labelled``, which holds all their rows of both ledgers.

        The rows are staged first, and a rewrite cut short is repeated from there.
        """
        self.store.replace("rewrite", labelled.select(*TXN_COLUMNS))
        return self._finish_rewrite()

    def _finish_rewrite(self) -> dict[str, int]:
        staged = self.store.generation("rewrite")
        done = self.store.read("rewritten", REWRITTEN).first()
        if staged <= (done.rewritten if done else 0):
            return {}
        rows = self.store.read("rewrite", TXN)
        written = {k: self.store.rewrite_months(k, rows.filter(dedup.ledger_kind("account") == k)) for k in KINDS}
        self.rebuild()
        self.store.replace("rewritten", self.store.spark.createDataFrame([(staged,)], REWRITTEN))
        return written

    def rebuild(self) -> None:
        """Index and watermarks of the ledgers as they stand."""
        history = self.store.read_all()
        self.index.rebuild(history, self.store.generation("batch"))
        self.store.replace("watermarks", guard.latest_by_account(history).select(*WATERMARK.fieldNames()))
        self._save_state(self.store.generation("batch"))

    def watermark(self) -> DataFrame:
        """Newest booked day of each account (L1), kept up with every batch."""
        return self.store.read("watermarks", WATERMARK)

    # -- booking ---------------------------------------------------------------
    def book(self, labelled: DataFrame) -> DataFrame:
        """Stages a labelled batch and books it; returns the staged rows."""
        self.store.replace("batch", labelled)
        self._book(self.store.generation("batch"), repeated=False)
        return self.batch()

    def batch(self) -> DataFrame:
        return self.store.read("batch", BATCH)

    def _book(self, number: int, repeated: bool) -> None:
        rows = self.batch().select(*TXN_COLUMNS)
        for kind in KINDS:
            part = rows.filter(dedup.ledger_kind("account") == kind)
            if repeated:
                # Equal rows of before the batch were removed as duplicates, so those found are its own.
                part = part.exceptAll(self._near(kind, rows).select(*TXN_COLUMNS))
            self.store.append_ledger(kind, part)
        newest = rows.groupBy("account").agg(F.max("txn_date").alias("latest")).filter("latest IS NOT NULL")
        merged = self.watermark().unionByName(newest).groupBy("account").agg(F.max("latest").alias("latest"))
        self.store.replace("watermarks", merged)
        self.index.append(rows, number)
        self._save_state(number)

    def _near(self, kind: str, rows: DataFrame) -> DataFrame:
        """Ledger rows of the months and accounts of a batch; whole months are pruned at the scan."""
        months = [r[0] for r in rows.select(F.date_format("txn_date", "yyyy-MM")).distinct().collect()]
        ledger = self.store.read_ledger(kind, [m for m in months if m])
        return ledger.join(rows.select("account").distinct(), "account", "left_semi")

    def unseen(self, fresh: DataFrame, ignore: Sequence[dict] = ()) -> DataFrame:
        """D3-D5 against the part of the ledgers that can hold the batch's keys."""
        near = [self._near(kind, fresh) for kind in KINDS]
        found = dedup.find_new(near[0].unionByName(near[1]), fresh, accounts=self.watermark())
        return dedup.drop_ignored(found, ignore)

    def label(self, rows: DataFrame, matchers: Sequence[dict], predictions: DataFrame | None = None) -> DataFrame:
        """K14-K19 with the stored index and label cache; accepted predictions enter the cache."""
        spark, cached = self.store.spark, self.store.location("label-cache") is not None
        cache = self.store.read("label-cache", LABEL_CACHE)
        vocab = vocabulary(self.store.read_all(), matchers) if cached or predictions is not None else None
        index = self.index.load(query_keys(rows))
        done = categorize(rows, index, matchers, cache if cached else None, vocab)
        if predictions is None:
            return done
        done, accepted = apply_predictions(done, predictions, vocab)
        kept = merge_cache(cache if cached else spark.createDataFrame([], LABEL_CACHE), accepted)
        self.store.replace("label-cache", kept.select(*LABEL_CACHE.fieldNames()))
        return done

    def ingest(
        self, parsed: DataFrame, matchers: Sequence[dict], ignore: Sequence[dict] = (), predictions: DataFrame | None = None
    ) -> DataFrame:
        """A13, D3-D5, K14-K19 and L5 for standard transactions of any files."""
        fresh = standardize.after_watermark(parsed, self.watermark()).select(*TXN_COLUMNS)
        fresh = self.store.rewrite("fresh", fresh)
        unseen = self.store.rewrite("unseen", self.unseen(fresh, ignore))
        if unseen.isEmpty():
            return self.store.spark.createDataFrame([], BATCH)
        labelled = self.label(unseen, matchers, predictions).select(*BATCH.fieldNames())
        return self.book(self.store.rewrite("labelled", labelled))


def late_rows(parsed: DataFrame, watermark: DataFrame) -> DataFrame:
    """Rows not after their account's newest booked day; an account without one has none."""
    return parsed.join(watermark, "account").filter(F.col("txn_date") <= F.col("latest")).select(*parsed.columns)
