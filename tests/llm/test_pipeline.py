"""The pipeline's stages on small tables, and the queries with an SQL text against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    theirs = con.sql(queries.ORACLES[name])
    columns = sorted(theirs.columns)
    ours = queries.QUERIES[name](spark, SF)
    assert sorted(ours.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    left = sorted(tuple(str(r[c]) for c in columns) for r in ours.collect())
    assert left == sorted(tuple(str(r[i]) for i in at) for r in theirs.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages_keep_columns_and_take_effect(spark):
    extra = spark.createDataFrame(
        [(10_001, None), (10_002, ""), (10_003, "x " * 9), (10_003, "x " * 9), (None, "no id here"), (None, None)], "doc_id long, text string"
    )
    for c, kind in (("lang", "string"), ("source", "string"), ("n_chars", "long")):
        extra = extra.withColumn(c, F.lit(None).cast(kind))
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(extra).withColumn("__hit", F.lit(1)).withColumn("fp", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        docs = out
    toxic = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1")
    assert docs.join(toxic, "doc_id", "left_semi").count() == 0
    assert docs.groupBy("doc_id").count().filter("count > 1").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
