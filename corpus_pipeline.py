"""From raw documents to packed training sequences.

Each stage reads the rows its predecessor kept, as written Parquet; all but the last
return the columns of ``documents``. The last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import copies, decontaminate, linededup, packing, toxicity
from ledgerloom.llm.common import free_name, new_stage, remove_folder
from ledgerloom.llm.tokens import vocabulary_path

ORACLE_SQL = None  # trained scores, fingerprints and packing have no SQL form


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject, each row by its own text."""
    net = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted_documents(docs, net)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten documents share; ``n_chars`` follows the text."""
    kept = linededup.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id.

    Copies have a five-word similarity of 0.8, found by fingerprints and verified exactly.

    Rows carry a number of their own from the stage's entry on, so null and repeated ids
    neither join different texts nor part copies.
    """
    own = free_name(docs, "__row")
    numbered, _ = new_stage(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    groups = copies.near_copies(numbered.select(F.col(own).alias("row"), "text"))
    ids = numbered.select(F.col(own).alias("row"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull(), "id", "row")
    kept = groups.join(ids, "row").groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.row").alias(own))
    return numbered.join(kept, own, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as packed sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate_documents),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a folder; each one's rows are written and read again.

    A stage's table goes once the next one is written; the last one is the result.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, where = new_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            remove_folder(spark, before)
        before = where
    return docs
