"""Nearest neighbours, importance resampling and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import importance, lexical, neighbours, queries, terms

SF = "/root/testdata/sf0.001"


def odd_texts():
    rng = random.Random(8)
    words = ["the", "The", "stone", "río", "日本", "x1", "7", "harbour", "w" * 90]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    return [None, "", " \n", "!!!", "The stone, the STONE", "río_río-日本", long, "a b", "İ ß É"] + [
        " ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)
    ]


def rows_of(spark, texts, extra=True):
    ids = [None, None, 3, 3, *range(100, 96 + len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    for c in ("d", "t", "row", "rank", "score", "item", "place", "range") if extra else ():
        df = df.withColumn(c, F.lit(1))
    return df


def test_terms_of_each_text():
    texts = odd_texts()
    column = pa.array(texts)
    found = terms.Terms(column[2:])  # with an offset
    values = [v.decode() for v in found.values.to_pylist()]
    wanted = [plain_words(t) for t in texts[2:]]
    assert [values[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)] == wanted
    parts = list(terms.slices([pa.RecordBatch.from_arrays([column], names=["t"])], 0))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts


# -- 13: lexical search ----------------------------------------------------------------


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_ranking(docs, items, k):
    bags = [plain_words(t) for _, t in docs]
    n_docs, total = sum(bool(b) for b in bags), sum(map(len, bags))
    out = []
    for item, text in items:
        scored = []
        for (doc, _), bag in zip(docs, bags, strict=True):
            score = 0
            for term in plain_words(text):
                tf, df = bag.count(term), sum(term in set(b) for b in bags)
                if tf:
                    m = 100 - 75 + (75 * len(bag) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_lexical_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    texts = odd_texts()
    docs = rows_of(spark, texts)
    given = [(1, "stone stone harbour"), (2, None), (3, "!"), (None, "río 日本"), (4, "unknownterm"), (1, "stone stone harbour"), (5, texts[12])]
    items = spark.createDataFrame(given, "item_id long, text string").withColumn("n", F.lit(1))
    found = [tuple(r) for r in lexical.rank_documents(docs, items, k=4).collect()]
    wanted = plain_ranking([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], given, 4)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(found, key=key) == sorted(wanted, key=key)
    assert lexical.rank_documents(docs.limit(0), items).count() == 0 and lexical.rank_documents(docs, items.limit(0)).count() == 0


def test_heaps_of_many_ties_stay_small():
    heaps = lexical._Heaps(1, 3)
    for a in range(0, 300_000, 1000):
        heaps.push(np.zeros(1000, np.int64), np.arange(a + 999, a - 1, -1), np.zeros(1000, bool), np.full(1000, 5))
    assert heaps.size < 1 << 18
    heaps.settle()
    assert heaps.held[1].tolist() == [0, 1, 2]


# -- 12: importance resampling -----------------------------------------------------------


def plain_features(text):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for texts, counts in ((x for _, x in docs), s), (target, t):
        for text in texts:
            for f in plain_features(text):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10000.0) / ((a + 1.0) * (sum(t) + 10000.0)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc, text in docs:
        f = plain_features(text)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): n + 1 for n, r in enumerate(able[: 5 * len(able) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


KEY = lambda r: tuple((x is None, x or 0) for x in r)


def test_resampling_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(importance, "DICTIONARY_BYTES", 64)  # the dictionary starts anew again and again
    docs = rows_of(spark, odd_texts())
    target = spark.createDataFrame([("stone harbour",), (None,), ("the río",)], "text string")
    found = [tuple(r) for r in importance.resample(docs, target).collect()]
    wanted = plain_resample([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], ["stone harbour", None, "the río"])
    assert sorted(found, key=KEY) == sorted(wanted, key=KEY) and any(r[4] for r in wanted)
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == docs.count()


def test_resampling_query_on_the_table(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = [tuple(r) for r in queries.importance_resampling(spark, SF).collect()]
    wanted = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert sorted(found, key=KEY) == sorted(wanted, key=KEY) and sum(r[4] is not None for r in found) > 0


def test_crc_of_joined_words():
    advance, rng = importance.Advance(), random.Random(3)
    parts = [(rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.randint(0, 300))) for _ in range(200)]
    left, right = (np.array([zlib.crc32(p[i]) for p in parts], np.uint32) for i in (0, 1))
    joined = advance.join(left, right, np.array([len(b) for _, b in parts]))
    assert joined.tolist() == [zlib.crc32(a + b" " + b) for a, b in parts]


# -- 11: nearest neighbours --------------------------------------------------------------


def plain_nearest(rows, every, k):
    """(query, neighbours as (distance, id)) of each query row, over usable vectors."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in good), default=0)
    m = np.array([np.pad(v, (0, width - len(v))) for _, v in good])
    ids = np.array([i for i, _ in good])
    for at in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((m - m[at]) ** 2).sum(axis=1))
        order = [n for n in np.lexsort((ids, d)) if n != at][:k]
        yield int(ids[at]), [(float(d[n]), int(ids[n])) for n in order]


def test_neighbours_of_odd_rows_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(60)] + [(i, [0.5] * 5) for i in range(60, 110)]
    rows += [(200, None), (201, []), (202, [1.0, None]), (203, [float("nan")] * 5), (204, [0.0] * 5), (220, [2.0, -1.0]), (None, [1.0] * 5)]
    rows += [(40, [1.5] * 5), (40, [1.5] * 5), (7, [9.0] * 5), (221, [1e150] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("x")).withColumn("id", F.lit("y"))
    index = neighbours.build_index(table)
    index.lists.probes = len(index.lists.centres)  # all lists: only the tests of the scan may lose a row
    found = {}
    for r in neighbours.nearest(table.repartition(3), every=20, k=7).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wanted = {}
    for q, near in plain_nearest(rows, 20, 7):
        wanted.setdefault(q, []).extend((n + 1, i, d) for n, (d, i) in enumerate(near))
    assert set(found) == set(wanted)
    same = sum(len({x[:2] for x in found[q]} & {x[:2] for x in wanted[q]}) for q in wanted) / sum(len({x[:2] for x in w}) for w in wanted.values())
    assert same >= 0.9
    distances = {(q, i): d for q, w in wanted.items() for _, i, d in w}
    assert all(distances.get((q, i), d) == pytest.approx(d) for q, w in found.items() for _, i, d in w if q != 40)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [5.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest(few).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 4.0)]
    assert neighbours.nearest(few.limit(0)).count() == 0 and neighbours.nearest(few.filter("vec_id > 0")).count() == 0


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = {}
    for r in neighbours.nearest(table).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for q, near in plain_nearest([(r.vec_id, r.embedding) for r in table.collect()], 100, 10):
        total += len(near)
        hits += sum(i in found[q] for _, i in near)
        assert all(found[q][i] == pytest.approx(d, abs=1e-12) for d, i in near if i in found[q])
    assert hits / total >= 0.95, hits / total
