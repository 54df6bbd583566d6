"""Statement files: listing and raw grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATEMENT_GLOB = "*.{csv,pdf}"

# One record: anything up to a line end outside quotes.
_RECORD = r'(?:[^"\n]++|"(?:[^"]++|"")*+"?+)*+(?:\n|\z)'
# One cell of a record that starts with a comma.
_CELL = r',("(?:[^"]++|"")*+"?+[^,]*+|[^,]*+)'


def list_statements(spark: SparkSession, path: str) -> DataFrame:
    """Every ``.csv`` / ``.pdf`` file with id and name. Contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", STATEMENT_GLOB).load(path)
        .select(
            F.col("path").alias("file_id"),
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            "length",
            F.col("modificationTime").alias("modified"),
        )
    )


def _cells(record: Column) -> Column:
    """Cells of a record, unquoted; a blank line has none."""
    line = F.regexp_replace(record, r"\n\z", "")
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), 1)
    plain = F.transform(
        raw,
        lambda c: F.when(
            c.startswith('"'), F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"'))
        ).otherwise(c),
    )
    return F.when(line == "", F.array().cast("array<string>")).otherwise(plain)


def plain_path(path: Column) -> Column:
    """A file's path as its id: readers write the local scheme in different ways."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def explode_records(files: DataFrame) -> DataFrame:
    """S2 for files at hand: ``value`` holds a file's whole text."""
    text = F.regexp_replace("value", "\r\n?", "\n")
    records = F.filter(F.regexp_extract_all(text, F.lit(_RECORD), 0), lambda r: r != "")
    return (
        files.select("file_id", "file_name", F.posexplode(records).alias("row_no", "record"))
        .select("file_id", "file_name", F.col("row_no").cast("long").alias("row_no"), _cells(F.col("record")).alias("cells"))
    )


def read_statement_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of every file as arrays of text, preamble included, no header.

    One scan: a file is a row, its records are exploded with their position, so every
    line counts, blank ones included, and quoted line breaks stay inside their cell.
    Records may have any number of cells. A statement is a document of bounded size.
    """
    return explode_records(
        spark.read.option("pathGlobFilter", "*.csv").text(paths, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_name").alias("file_name"))
    )
