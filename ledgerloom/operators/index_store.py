"""The category index as stored counts that grow with each booked batch.

An index is counts: votes per (norm, sign, category), rows per token, and rows per token
set and category. Counts of two parts of a history add up to those of the whole, so a
batch becomes one more generation of counts, and a reader adds the generations. Weights
(idf, vector lengths) change with every batch; they are derived from the sums when read.

One table holds the three kinds, partitioned by (generation, kind): a batch is appended in
one write. Delta generations have even numbers, a compaction of everything up to batch g
has the odd number 2g + 1, so a replayed batch is recognised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import tokens_of_norm
from ledgerloom.operators.category_index import CategoryIndex, count_votes, docs_of_sets, token_sets
from ledgerloom.schema import AMOUNT
from ledgerloom.sources.ledger import TableStore

VOTES, TOKENS, SETS = "votes", "tokens", "sets"
PARTITIONS = ["generation", "kind"]
ALL_ROWS = ""  # the token that counts rows having tokens
MOST_DELTAS = 16
DELTA_SHARE = 0.25


def counts_schema(history_order: str) -> T.StructType:
    seen = [
        T.StructField("txn_date", T.DateType()),
        T.StructField("account", T.StringType()),
        T.StructField("amount", AMOUNT),
        T.StructField("description", T.StringType()),
    ]
    if history_order == "ledgers":
        seen = [T.StructField("ledger", T.StringType()), *seen]
    return T.StructType(
        [
            T.StructField("norm", T.StringType()),
            T.StructField("is_debit", T.BooleanType()),
            T.StructField("token_set", T.ArrayType(T.StringType())),
            T.StructField("token", T.StringType()),
            T.StructField("category", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("first_seen", T.StructType(seen)),
            T.StructField("generation", T.LongType()),
            T.StructField("kind", T.StringType()),
        ]
    )


class IndexStore:
    """A category index below a table store, by name."""

    def __init__(self, store: TableStore, name: str = "index", history_order: str = "ledgers") -> None:
        self.store, self.name, self.history_order = store, name, history_order
        self.schema = counts_schema(history_order)

    # -- reading ---------------------------------------------------------------
    def exists(self) -> bool:
        return self.store.location(self.name) is not None

    def _kind(self, kind: str) -> DataFrame:
        return self.store.read(self.name, self.schema).filter(F.col("kind") == kind)

    def votes(self, keys: DataFrame | None = None) -> DataFrame:
        """Summed votes, as ``count_votes`` of the whole history; with ``keys`` only theirs."""
        rows = self._kind(VOTES)
        if keys is not None:
            rows = rows.join(keys, ["norm", "is_debit"], "left_semi")
        return rows.groupBy("norm", "is_debit", "category").agg(
            F.sum("n").alias("votes"), F.min("first_seen").alias("first_seen")
        )

    def idf(self) -> DataFrame:
        """As ``build_idf`` of the whole history: the total is corrected by every generation."""
        sums = self._kind(TOKENS).groupBy("token").agg(F.sum("n").alias("df"))
        total = sums.filter(F.col("token") == ALL_ROWS).agg(F.sum("df")).scalar()
        return sums.filter(F.col("token") != ALL_ROWS).select("token", "df", F.ln(total / F.col("df")).alias("idf"))

    def sets(self, tokens: DataFrame | None = None) -> DataFrame:
        """Summed token sets; with ``tokens`` only those that hold one of them."""
        rows = self._kind(SETS)
        if tokens is not None:
            met = (
                rows.select("is_debit", "token_set", F.explode("token_set").alias("token"))
                .join(tokens, "token", "left_semi")
                .select("is_debit", "token_set")
                .distinct()
            )
            rows = rows.join(met, ["is_debit", "token_set"], "left_semi")
        return rows.groupBy("is_debit", "token_set", "category").agg(F.sum("n").alias("n"))

    def load(self, keys: DataFrame) -> CategoryIndex:
        """The index as far as a batch's (norm, is_debit) keys can see it.

        Only the votes of these keys and the token sets that share a token with them are
        read on; a document without a common token has similarity 0. Weights and vectors
        are written once, over those of the batch before.
        """
        tokens = keys.select(F.explode(tokens_of_norm("norm")).alias("token")).distinct()
        idf = self.store.rewrite(f"{self.name}-idf", self.idf())
        docs = self.store.rewrite(f"{self.name}-docs", docs_of_sets(self.sets(tokens), idf))
        return CategoryIndex(self.votes(keys), idf, docs)

    # -- writing ---------------------------------------------------------------
    def _counts(self, history: DataFrame, generation: int) -> DataFrame:
        votes = self.store.rewrite(f"{self.name}-fresh", count_votes(history, self.history_order))
        sets = token_sets(votes)
        tokens = sets.select(F.explode(F.concat("token_set", F.array(F.lit(ALL_ROWS)))).alias("token"), "n")
        tokens = tokens.groupBy("token").agg(F.sum("n").alias("n"))
        parts = {VOTES: votes.withColumnRenamed("votes", "n"), TOKENS: tokens, SETS: sets}
        return self._united(parts, generation)

    def _united(self, parts: dict[str, DataFrame], generation: int) -> DataFrame:
        out = None
        for kind, part in parts.items():
            given = {f.name: F.col(f.name) if f.name in part.columns else F.lit(None) for f in self.schema.fields}
            given |= {"generation": F.lit(generation), "kind": F.lit(kind)}
            part = part.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in self.schema.fields])
            out = part if out is None else out.unionByName(part)
        return out

    def generations(self) -> dict[int, int]:
        """Bytes of each stored generation."""
        return {int(k): v for k, v in self.store.partition_bytes(self.name, "generation").items()}

    def rebuild(self, history: DataFrame, generation: int = 0) -> None:
        """The index of a whole history, in place of what is stored: after rewrites of a ledger."""
        self.store.replace(self.name, self._counts(history, 2 * generation + 1), PARTITIONS)

    def append(self, labelled: DataFrame, generation: int) -> bool:
        """One booked batch as a delta; False if a compaction holds it already.

        The same number again replaces its own delta, so a repeated batch counts once.
        """
        number, held = 2 * generation, self.generations()
        if held and number < max(held):
            return False
        self.store.put_partitions(self.name, self._counts(labelled, number), PARTITIONS)
        self.compact()
        return True

    def compact(self, force: bool = False) -> bool:
        """Adds the generations into one when the deltas are many or large."""
        held = self.generations()
        base = max([g for g in held if g % 2], default=-1)
        deltas = {g: size for g, size in held.items() if g > base}
        small = len(deltas) <= MOST_DELTAS and sum(deltas.values()) <= DELTA_SHARE * max(1, held.get(base, 0))
        if not deltas or (small and not force) or (len(held) == 1 and not force):
            return False
        tokens = self._kind(TOKENS).groupBy("token").agg(F.sum("n").alias("n"))
        parts = {VOTES: self.votes().withColumnRenamed("votes", "n"), TOKENS: tokens, SETS: self.sets()}
        self.store.replace(self.name, self._united(parts, max(held) + 1), PARTITIONS)
        return True
