"""Line deduplication: lines that many documents share are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_name, new_stage

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without outer blanks, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _fingerprint(key: Column) -> Column:
    """128 bits of a key: two chained hashes of different seeds."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_repeated_lines(
    docs: DataFrame, min_documents: int = 10, min_length: int = 1, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every document with the lines removed whose key at least ``min_documents`` hold.

    Returns all columns of ``docs`` with ``text`` replaced, plus ``__n_lines`` and
    ``__n_dropped``. Rows of one id count as one document; each row without an id counts as
    a document of its own. A null or empty text is one empty line. Repeated rows stay.
    A document whose lines all go keeps an empty text. An empty table stays empty.

    Rows get a number of their own, under which their lines are exploded to (row, position,
    fingerprint). Fingerprints are counted, those over the threshold are a table, and it
    gives each row the positions that go. The row's lines are put together again from the
    positions that stay. The text itself meets only its own positions, by row, so a line
    shared by a third of all documents moves as 32 bytes each and is spread by row.
    """
    own, split = free_name(docs, "__row"), free_name(docs, "__lines")
    i, t = F.col(f"`{id_column}`"), F.col(f"`{text}`")
    numbered, _ = new_stage(docs.withColumn(own, F.monotonically_increasing_id()), "numbered-lines")
    row = F.col(f"`{own}`")
    lines = numbered.select(row.alias("row"), i.alias("id"), F.posexplode(_lines(t)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_length)
    held = keyed.select("row", "id", "pos", _fingerprint(F.col("key")).alias("f")).select("row", "id", "pos", "f.a", "f.b")
    # Counting (fingerprint, document) first spreads a hot fingerprint over all documents.
    document = (F.col("id").isNull().alias("none"), F.coalesce(F.col("id").cast("string"), F.col("row").cast("string")).alias("document"))
    pairs = held.select("a", "b", *document).distinct()
    frequent = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_documents)
    # As a table of its own the join can split the rows of a hot fingerprint.
    frequent, _ = new_stage(frequent.select("a", "b"), "repeated-lines")
    gone = held.join(frequent, ["a", "b"], "left_semi").groupBy("row").agg(F.collect_list("pos").alias("gone"))
    dropped, key = free_name(docs, "__gone"), free_name(docs, "__own")
    gone = gone.select(F.col("row").alias(key), F.col("gone").alias(dropped))
    joined = numbered.withColumn(split, _lines(t)).join(gone, row == F.col(key), "left")
    # Positions as a set difference: one pass over the lines, however many go.
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(dropped))
    kept = F.when(F.col(dropped).isNull(), F.array_join(split, "\n")).otherwise(
        F.array_join(F.transform(stay, lambda n: F.get(F.col(split), n)), "\n")
    )
    columns = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(
        *columns,
        F.size(split).cast("long").alias("__n_lines"),
        F.when(F.col(dropped).isNull(), 0).otherwise(F.size(dropped)).cast("long").alias("__n_dropped"),
    )
