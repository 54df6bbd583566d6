"""Near copies of the pipeline against brute force, and the rows that stages decide on."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import copies, decontaminate, toxicity

SF = "/root/testdata/sf0.001"


def plain_roots(texts):
    """Group of each text: five-word Jaccard of at least 0.8, connected."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
            root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def planted(seed):
    """Texts with edited copies around the threshold, chains, a shared passage and odd texts."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    passage, texts = words(40), [None, "", " \n", "!!!", "???", "short text", "Short  text"]
    for _ in range(25):
        body = words(rng.choice([6, 40, 150])) + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(body))
            for _ in range(rng.randint(0, 1 + len(body) // 40)):
                body = list(body)
                body[rng.randrange(len(body))] = f"edit{rng.random()}"
    return texts


@pytest.mark.parametrize("tile", [4096, 5])
def test_near_copies_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(copies, "TILE", tile)  # small tiles: many chunks a key, and common keys
    texts = planted(4)
    frame = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    found = {r.row: r.root for r in copies.near_copies(frame).collect()}
    groups = lambda of: sorted(sorted(i for i in range(len(texts)) if of[i] == g) for g in set(of))
    wanted = groups(plain_roots(texts))
    assert groups([found[i] for i in range(len(texts))]) == wanted
    assert any(len({texts[i] for i in g}) > 2 for g in wanted)
    assert copies.near_copies(frame.limit(0)).count() == 0


def test_stage_drops_copies_beyond_four_bits(spark):
    texts = planted(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    roots = plain_roots(texts)
    assert kept == sorted({g: min(i for i, r in enumerate(roots) if r == g) for g in roots}.values())


def test_stages_judge_rows_and_not_ids(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda: " ".join(f"u{rng.randint(0, 9999)}" for _ in range(60))
    item = text()
    rows = [(None, text()), (None, f"{text()} {item}"), (None, text()), (7, text()), (7, f"{item} {text()}"), (8, text()), (8, text())]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = lambda out: sorted(r.n for r in out.collect())
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert kept(decontaminate.clean_documents(docs, items)) == [0, 2, 3, 5, 6]
    assert kept(corpus_pipeline.near_dedup(spark, docs, SF)) == list(range(7))
    monkeypatch.setattr(toxicity, "PREDICT_AT", 0.5)
    net = toxicity.fit_network(["bad word", "good thing"] * 40, np.array([1, 0] * 40))
    docs = spark.createDataFrame([(None, "bad word", 0), (None, "good thing", 1), (3, "good thing", 2), (3, "bad word", 3)], docs.schema)
    assert kept(toxicity.accepted_documents(docs, net)) == [1, 2]


def test_rows_follow_the_classes_and_not_their_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = words(100)
    texts = [" ".join(passage + words(30)) for _ in range(300)]  # all pairs near 0.6: none is a copy
    texts += [texts[0] + " more", texts[7] + " again"]
    written, new_stage = [], copies.new_stage

    def counted(df, purpose):
        table, where = new_stage(df, purpose)
        written.append((table.count(), purpose))
        return table, where

    monkeypatch.setattr(copies, "new_stage", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    found = {r.row: r.root for r in copies.near_copies(frame).collect()}
    assert found[300] == found[0] and found[301] == found[7] and len(set(found.values())) == 300
    assert max(written)[0] <= copies.KEYS * len(texts), max(written)
