"""Results that earlier forms cut: class members, small groups, exact cutoffs, long texts."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import queries, shards, topk, toxicity


def test_each_item_of_a_text_is_reported(spark, tmp_path):
    text = "one two three four five six seven"
    spark.createDataFrame([(1, f"zero {text} eight")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, text), (2, text), (9, text), (None, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.contaminated(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(1, 2, 1.0), (1, 4, 1.0), (1, 9, 1.0)]


def test_cutoff_beyond_exact_doubles(spark):
    rows = [(0, [1 / 64, 1 / 64]), (1, [2.0**47, 3 / 64])]
    found = topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1).collect()
    assert list(map(tuple, found)) == [(0, 1, 1, 2**53 + 3)]


def test_capacity_holds_with_many_small_groups(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lpad(F.hex("id"), 5, "0").alias("text"))
    rows = shards.shard_documents(docs, capacity=8000).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert sum(r.s for r in rows) == 600_000
    assert max(r.s for r in rows) <= 8000 and len(rows) <= 76


def test_training_reads_all_windows(spark, monkeypatch):
    filler = " ".join(["plain"] * 1500)
    docs = spark.createDataFrame([(i, f"{filler} insult {filler}" if i % 2 else filler) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_sample", lambda sample, y: seen.append((sample, y)))
    toxicity.train_toxicity(docs, labels)
    (sample, y), insult = seen[0], toxicity.Sample.of_texts(["insult"]).hashes[0]
    assert sorted(np.diff(sample.first).tolist()) == [1500] * 4 + [3001] * 4 and sorted(y.tolist()) == [0] * 4 + [1] * 4
    held = [insult in sample.hashes[a:e] for a, e in zip(sample.first[:-1], sample.first[1:], strict=True)]
    assert held == [x == 1 for x in y]
    assert len(sample.slots) == sample.grams.sum() and len(sample.grams) == len(sample.hashes)
