"""Each corpus operator against a brute-force version, and on the cases its docstring names."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, linededup, packing, quality, shards, simhash, tokenfile, tokens, topk, toxicity, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_documents(spark):
    """Nulls, empty and blank texts, a long text, repeats, and columns named like internals."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, long), (5, "same words in both of these texts"), (5, "same words in both of these texts"),
        (6, "same words in both of these texts"), (None, "a text without an id"), (None, None), (7, "Ünïcode ñandú 日本 \u00a0 x"),
        (8, "two  spaces   three\n\n\nlines \n x "), (9, "<|endoftext|> it's"),
    ]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    for c in ("__id", "fp", "id", "score", "shard", "__gone", "host", "piece"):
        df = df.withColumn(c, F.lit(1))
    return df


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def whole_ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


# -- tokens ------------------------------------------------------------------------


def test_piecewise_encoding_equals_the_library(spark, library):
    texts = [r.text for r in documents(spark).select("text").collect()] + [r.text for r in odd_documents(spark).select("text").collect()]
    rng = random.Random(5)
    alphabet = ["a", "Bc", " ", " ", "\n", "\t", ".", ",", "!?", "'s", "'", "12", "ñ", "日", "\u00a0", "\x1c", "$$$", "|"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(5000)]
    tok = tokens.PieceTokenizer(tokens.vocabulary_path())
    for text, raw in zip(texts, tok.encode(texts), strict=True):
        assert tokens.ids_of(raw).tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


# -- 10: token files -----------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_rank_coding_round_trip(n):
    rng = np.random.default_rng(n)
    ranks = (rng.integers(0, 1 << 32, n, np.uint64) >> rng.integers(0, 32, n, np.uint64)).astype(np.uint32)
    assert tokenfile.decode_ranks(*tokenfile.encode_ranks(ranks), n).tolist() == ranks.tolist()


@pytest.mark.parametrize("source", [documents, odd_documents, no_documents])
def test_token_files_read_back(spark, library, tmp_path, source):
    docs = source(spark)
    tokenfile.write_token_files(docs, tokens.vocabulary_path(), str(tmp_path / "out"))
    found = sorted(tokenfile.read_token_files(spark, str(tmp_path / "out")).collect(), key=lambda r: r.start)
    wanted = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in found] == [r.doc_id for r in wanted]
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    crcs = lambda rows: sorted((r.doc_id or -1, len(x), zlib.crc32(x.tobytes())) for r in rows for x in [whole_ids(library, r.text)])
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in found) == crcs(wanted)


def test_damaged_token_file_is_noticed():
    block = tokenfile.pack_block(0, 0, [1], [3], np.array([1, 2, 3], np.uint32)) + b"\n"
    assert [x[2] for x in tokenfile.blocks_of(block)] == [[1]]
    with pytest.raises(ValueError, match="damaged"):
        list(tokenfile.blocks_of(block[:-8] + b"\x00" + block[-7:]))


# -- 3: packing ----------------------------------------------------------------------


def fewest_bins(sizes, capacity):
    """Exact bin count of a small instance."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_bounds_never_exceed_the_optimum():
    rng = random.Random(3)
    functions = packing.dual_feasible(30)
    for _ in range(60):
        sizes = sorted((rng.randint(1, 30) for _ in range(9)), reverse=True)
        bound, exact = packing.lower_bound(np.array(sizes), functions), fewest_bins(sizes, 30)
        where, offsets, left = packing.best_fit_decreasing(sizes, 30)
        assert bound <= exact <= len(left)
        for b in range(len(left)):
            inside = sorted((o, n) for o, n, w in zip(offsets, sizes, where, strict=True) if w == b)
            assert [o for o, _ in inside] == list(itertools.accumulate([0, *[n for _, n in inside[:-1]]]))
            assert sum(n for _, n in inside) + left[b] == 30


@pytest.mark.parametrize("source", [documents, odd_documents, no_documents])
def test_packed_documents_are_whole(spark, library, source):
    docs = source(spark)
    rows = packing.pack_documents(docs, tokens.vocabulary_path(), group_pieces=40).collect()
    wanted = []
    for r in docs.collect():
        ids = whole_ids(library, r.text)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]  # only the first piece may be shorter
        wanted += [(r.doc_id or -1, k, a, e - a, zlib.crc32(ids[a:e].tobytes())) for k, (a, e) in enumerate(itertools.pairwise(cuts))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)
    for _, pieces in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        end = 0
        for r in pieces:
            assert r.offset == end
            end += r.length
        assert end <= 1024
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 1024) * 1.05 + 2


# -- 4: SimHash ----------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def plain_components(prints):
    group = {f: f for f in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4 and find(a) != find(b):
            group[find(a)] = find(b)
    return {f: find(f) for f in prints}


@pytest.mark.parametrize("source", [documents, odd_documents, no_documents])
def test_simhash_groups_equal_brute_force(spark, source):
    docs = source(spark)
    texts = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in texts]
    roots = plain_components(set(prints))
    lowest = {}
    for r, f in zip(texts, prints, strict=True):
        if r.doc_id is not None:
            lowest[roots[f]] = min(lowest.get(roots[f], r.doc_id), r.doc_id)
    wanted = sorted((r.doc_id or -1, f"{f:016x}", lowest.get(roots[f])) for r, f in zip(texts, prints, strict=True))
    found = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == wanted


def test_links_join_chains_and_hot_buckets(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 64, 40, np.uint64)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for s in seeds for _ in range(8)]
    chain = list(itertools.accumulate(range(12), lambda f, k: f ^ (15 << (5 * k)), initial=int(seeds[0])))
    values = sorted({*map(int, seeds), *near, *chain})
    classes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    wanted = plain_components(values)
    for tile, count in ((4096, len(values)), (16, len(values)), (4096, 1 << 26)):
        edges = simhash.links(classes, count, tile=tile)
        found = {r.node & (2**64 - 1): r.root for r in simhash.components(edges).collect()}
        same = lambda of: {frozenset(v for v in values if of(v) == k) for k in {of(v) for v in values}}
        assert same(lambda v: found.get(v, v)) == same(lambda v: wanted[v])  # noqa: B023


# -- 8: shards -----------------------------------------------------------------------


def test_best_fit_decreasing_takes_the_tightest_bin():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(1, 40) for _ in range(60)]
        where = shards.best_fit_decreasing(sizes, 50)
        rooms, bins = [], {}
        for i in sorted(range(60), key=lambda i: (-sizes[i], i)):
            fitting = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
            b = min(fitting)[1] if fitting else len(rooms)
            if not fitting:
                rooms.append(50)
            rooms[b] -= sizes[i]
            bins[i] = b
        assert where == [bins[i] for i in range(60)]


@pytest.mark.parametrize("source", [documents, odd_documents, no_documents])
def test_shards_keep_groups_and_number_rows(spark, source):
    docs = source(spark)
    rows = shards.shard_documents(docs).collect()
    wanted = sorted((r.doc_id or -1, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in rows) == wanted
    by = {k: [r for r in rows if r.shard == k] for k in {r.shard for r in rows}}
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(16))
    shard_of = {}
    for r in rows:
        if r["size"] > 1:
            assert shard_of.setdefault((r["size"], r.text_crc32), r.shard) == r.shard
    if source is documents:
        loads = [sum(r["size"] for r in v) for v in by.values()]
        assert len(loads) == 16 and max(loads) <= 1.02 * sum(loads) / 16


def test_capacity_minimises_shards(spark):
    docs = spark.createDataFrame([(i, "x" * (59 if i % 2 else 39)) for i in range(400)], "doc_id long, text string")
    docs = docs.withColumn("text", F.concat("text", F.lpad(F.col("doc_id").cast("string"), 6, "0")))
    rows = shards.shard_documents(docs, capacity=6600)
    loads = [r.s for r in rows.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert max(loads) <= 6600 and len(loads) <= -(-sum(loads) // 6600) + 1


# -- 7: urls -------------------------------------------------------------------------

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), (None, "block"), ("net/es/", "block")]


def judged(url, default):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", tail)[0]
    path = re.match(r"[^?#]*", tail[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(r, v) for r, v in RULES if r and (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, default))
    return host, path, rule, verdict


@pytest.mark.parametrize("blocks", [1 << 20, 1])
def test_urls_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(urls, "FILTER_BLOCKS", blocks)
    given = [
        None, "", "no scheme", "http://", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://example.com/en", "x://example.com",
        "http://shop.net/es/a", "http://net/es/", "http://notnet/es/", "http://a.net/ES/", "http://b.com#f", "http://b.com?q=/en/", "http://x.org/a://b",
        "http://.com/", "http://com/ñ/é", "http://" + "a." * 20_000 + "net/es/x", "http://" + "." * 20_000,
    ]
    rng = random.Random(1)
    given += [f"http://{rng.choice(['www.', '', 'a.b.'])}{rng.choice(['example', 'net', 'x'])}.{rng.choice(['com', 'net', 'org'])}{rng.choice(['/en/', '/es/', '/', '/fr/p', ''])}" for _ in range(300)]
    pages = spark.createDataFrame([(i % 50 if i % 7 else None, u) for i, u in enumerate(given + given[:9])], "page_id long, url string").withColumn("host", F.lit(1))
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    found = sorted(map(tuple, ((r.page_id or -1, r.host, r.path, r.rule or "", r.verdict) for r in urls.judge_urls(pages, rules, "block").collect())))
    wanted = []
    for r in pages.collect():
        host, path, rule, verdict = judged(r.url, "block")
        wanted.append((r.page_id or -1, host, path, rule or "", verdict))
    assert found == sorted(wanted)
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert urls.judge_urls(pages, rules.limit(0)).filter("rule IS NOT NULL").count() == 0


def test_many_rules_with_one_path(spark, monkeypatch):
    monkeypatch.setattr(urls, "SEGMENT_BLOCKS", 8)  # the filter is put together from several segments
    rules = spark.createDataFrame([(f"h{i}.net/x/", "block") for i in range(3000)], "rule string, verdict string")
    pages = spark.createDataFrame([(i, f"http://www.h{i}.net/x/{i}") for i in range(2990, 3010)], "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert found == {i: (f"h{i}.net/x/", "block") if i < 3000 else (None, "allow") for i in range(2990, 3010)}


def test_blocked_bloom_has_no_false_negatives():
    rng = np.random.default_rng(0)
    keys, others = rng.integers(0, 1 << 64, 5000, np.uint64), rng.integers(0, 1 << 64, 20000, np.uint64)
    bloom = urls.BlockedBloom(urls.BlockedBloom.blocks_for(len(keys)))
    bloom.add(keys)
    assert bloom.may_hold(keys).all() and bloom.may_hold(others).mean() < 0.02


# -- 6: top k ------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(90)]
    rows += [(i, [0.5] * 6) for i in range(90, 130)]  # ties
    rows += [(130, None), (131, []), (132, [1.0, None]), (133, [float("nan")] * 6), (134, [float("inf")] * 6), (135, [2.0, -1.0]), (None, [1.0] * 6)]
    rows += [(7, [9.0] * 6), (140, [1e12] * 6), (141, [-3.0] * 6), (141, [-3.0] * 6)]
    rows += [(40, [-1.0] * 6), (40, [2.5] * 6), (60, rows[60][1])]  # several rows under one query id
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("id", F.lit("y"))
    found = sorted(map(tuple, topk.top_inner_products(table.repartition(3), every=20, k=7).collect()))
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wanted = []
    for at, (q, v) in enumerate(whole):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for n, (i, w) in enumerate(whole) if n != at)[:7]
            wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert found == sorted(wanted)
    assert topk.top_inner_products(table.limit(0)).count() == 0


# -- 9: lines ------------------------------------------------------------------------


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    shared = ["Menu", "  menu\t", "MENU ", "", " ", "Footer | ñ", "rare"]
    rows = [(i if i % 11 else None, "\n".join(rng.choices(shared[:6], k=rng.randint(0, 4)) + [f"own {i}"] * (i % 3))) for i in range(60)]
    rows += [(3, None), (4, ""), (5, "rare\nmenu"), (5, "rare\nmenu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__gone", F.lit(2)).withColumn("a", F.lit(3))
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for n, (i, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(("row", n) if i is None else i)
    gone = {k for k, ids in holders.items() if len(k) >= 1 and len(ids) >= 10}
    wanted = sorted((i or -1, "\n".join(x for x in (t or "").split("\n") if key(x) not in gone), (t or "").count("\n") + 1) for i, t in rows)
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "__n_lines", "__n_dropped"]
    assert sorted((r.doc_id or -1, r.text, r["__n_lines"]) for r in out.collect()) == wanted and gone
    assert linededup.drop_repeated_lines(no_documents(spark)).count() == 0


def test_lines_of_rows_without_id(spark):
    rows = [(None, f"own {n}\nshared") for n in range(12)] + [(n, "shared\nlast") for n in range(3)] + [(None, "twelve\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = sorted(r.text for r in linededup.drop_repeated_lines(docs).collect())
    assert texts == sorted([f"own {n}" for n in range(12)] + ["last"] * 3 + ["twelve\n\n"])


def test_document_of_many_shared_lines(spark):
    long = "\n".join(f"line {n}" if n % 2 else "own" for n in range(100_000))
    docs = spark.createDataFrame([(n, long) for n in range(2)], "doc_id long, text string")
    out = linededup.drop_repeated_lines(docs, min_documents=2).collect()
    assert [(r.text, r["__n_lines"], r["__n_dropped"]) for r in out] == [("", 100_000, 100_000)] * 2
    out = linededup.drop_repeated_lines(docs.limit(1).union(spark.createDataFrame([(7, "own\nx")], docs.schema)), min_documents=2).collect()
    assert sorted((r.doc_id, r.text.count("\n"), r["__n_dropped"]) for r in out)[-1] == (7, 0, 1)
    assert max(r["__n_dropped"] for r in out) == 50_000


# -- 2: decontamination --------------------------------------------------------------


def plain_contained(docs, items):
    words = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    classes = {}
    for i, t in items:
        if t is not None and words(t):
            classes[t] = min(classes.get(t, i), i)
    for d, t in docs:
        for item, i in classes.items():
            w = words(item)
            n = min(5, len(w))
            own = grams(w, n)
            share = len(own & grams(words(t), n)) / len(own)
            if share >= 0.8:
                yield d, i, round(share, 9)


def test_contained_items_equal_brute_force(spark):
    rng = random.Random(8)
    item = lambda n: " ".join(f"t{rng.randint(0, 400)}" for _ in range(n))
    items = [(i, item(rng.choice([1, 3, 5, 12, 30, 60]))) for i in range(30)] + [(40, None), (41, ""), (42, "!!"), (3, item(9))]
    items += [(50, items[5][1])]
    docs = []
    for d in range(60):
        body = item(rng.randint(0, 300)).split()
        own = rng.choice(items[:30])[1].split()
        if d % 2:  # a few words changed
            for _ in range(d % 3):
                own[rng.randrange(len(own))] = "changed"
        at = rng.randint(0, len(body))
        docs.append((d, " ".join([*body[:at], *(w.upper() + "!!" for w in own), *body[at:]])))
    docs += [(61, None), (62, ""), (None, items[7][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("d", F.lit(2))
    listed = spark.createDataFrame(items, "item_id long, text string")
    wanted = sorted((d if d is not None else -1, i, c) for d, i, c in plain_contained(docs, items))
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, round(r.containment, 9)) for r in decontaminate.contained_items(frame, listed).collect())
    assert found == wanted and len(wanted) > 20
    clean = {r.doc_id for r in decontaminate.clean_documents(frame, listed).collect()}
    assert clean == {d for d, _ in docs} - {d if d >= 0 else None for d, _, _ in wanted}
    assert decontaminate.contained_items(frame, listed.limit(0)).count() == 0
    assert decontaminate.contained_items(frame.limit(0), listed).count() == 0


# -- 1 and 5: classifiers ------------------------------------------------------------


def test_flattened_trees_equal_a_walk_down():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, quality.N_FEATURES))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit_trees(x, y)

    def walk(row):
        out = model.base
        for node in model.roots:
            while model.feature[node] >= 0:
                node = model.left[node] if row[model.feature[node]] <= model.split[node] else model.right[node]
            out += model.value[node]
        return out

    logits = model.logits(x)
    assert np.allclose(logits, [walk(r) for r in x]) and ((logits > 0) == y).mean() > 0.95


def test_quality_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.train_quality(docs, labels.filter(~held))
    rows = quality.score_quality(docs, model).join(labels.filter(held), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.93
    odd = quality.score_quality(odd_documents(spark), model).collect()
    assert len(odd) == 12 and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_quality(no_documents(spark), model).count() == 0
    assert quality.train_quality(no_documents(spark), labels.limit(0)).logits(np.zeros((1, quality.N_FEATURES)))[0] == 0


def test_network_gradients():
    """One recurrent direction against differences."""
    rng = np.random.default_rng(2)
    xw, u = rng.normal(size=(5, 3, 24)).astype(np.float32), rng.normal(size=(8, 24)).astype(np.float32) * 0.5
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], np.float32).T[:, :, None]
    aim = rng.normal(size=(5, 3, 8)).astype(np.float32)
    states, trail = toxicity._recur(xw, u, mask, True)
    d_xw, d_u = toxicity._recur_back(aim.copy(), trail, u, mask)
    value = lambda a, b: float((toxicity._recur(a, b, mask)[0] * aim).sum())
    for (t, n, k), (i, j) in zip([(0, 0, 1), (2, 1, 9), (4, 0, 20)], [(0, 3), (5, 12), (7, 23)], strict=True):
        step = np.zeros_like(xw)
        step[t, n, k] = 1e-2
        assert abs((value(xw + step, u) - value(xw - step, u)) / 2e-2 - d_xw[t, n, k]) < 2e-2
        step = np.zeros_like(u)
        step[i, j] = 1e-2
        assert abs((value(xw, u + step) - value(xw, u - step)) / 2e-2 - d_u[i, j]) < 5e-2


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 88, 89, 300):
        index, mask, _ = toxicity.windows_of(np.array([0, n]))
        assert set(index[mask].tolist()) == set(range(n))


def test_toxicity_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    net = toxicity.train_toxicity(docs, labels.filter(~held))
    known = docs.join(labels.filter(held), "doc_id", "left_semi")
    rows = toxicity.score_toxicity(known, net).join(labels.filter(held), "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.97
    odd = {(r.doc_id, round(r.score, 6)) for r in toxicity.score_toxicity(odd_documents(spark), net).collect()}
    assert {(1, 0.0), (2, 0.0), (3, 0.0)} <= odd
    assert toxicity.score_toxicity(no_documents(spark), net).count() == 0
    assert toxicity.train_toxicity(docs, labels.limit(0)).dense["bias"][0] < 0
