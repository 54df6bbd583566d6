"""Category index learned from labelled history: exact votes and TF-IDF neighbours.

The index is three tables:

``votes``     one row per (norm, is_debit, category): row count and first-seen key
``idf``       one row per token
``docs``      one row per (is_debit, token set): tokens in rarity order, vector length and
              the first three labels of its rows, category descending

Neighbours are ranked by *rows*. Rows with the same sign and token set have the same
similarity to any query, so only their three highest labels can reach a top three; the
collapse to one ``docs`` row is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import is_debit, norm, tokens_of_norm
from ledgerloom.operators.dedup import labelled, ledger_kind
from ledgerloom.session import shared_folder

# Fixed values of the consensus gate.
MIN_SIMILARITY = 0.80
TOP_K = 3
SIMILARITY_DIGITS = 12
# Safety margin for bounds computed in floating point.
EPS = 1e-9
# Vector lengths are grouped into bands of this many per factor of two.
BANDS_PER_OCTAVE = 4


@dataclass
class CategoryIndex:
    votes: DataFrame
    idf: DataFrame
    docs: DataFrame


def _written(table: DataFrame, purpose: str) -> DataFrame:
    spark, where = table.sparkSession, shared_folder(table.sparkSession, f"index-{purpose}")
    table.write.parquet(where)
    return spark.read.schema(table.schema).parquet(where)


def first_seen_key(history_order: str) -> Column:
    """Position of a row in history.

    ``ledgers``: bank rows precede card rows (incremental run); ``global``: one order.
    """
    parts = [F.col(c) for c in ("txn_date", "account", "amount", "description")]
    if history_order == "ledgers":
        parts = [ledger_kind("account").alias("ledger"), *parts]
    return F.struct(*parts)


def count_votes(history: DataFrame, history_order: str = "global") -> DataFrame:
    """Vote counts per (norm, is_debit, category) over labelled rows."""
    return (
        labelled(history)
        .select(
            norm("description").alias("norm"),
            is_debit("amount").alias("is_debit"),
            "category",
            first_seen_key(history_order).alias("seen"),
        )
        .filter("norm <> ''")
        .groupBy("norm", "is_debit", "category")
        .agg(F.count("*").alias("votes"), F.min("seen").alias("first_seen"))
    )


def build_exact(votes: DataFrame) -> DataFrame:
    """K4 / K5: majority category per key, ties to the first seen, with its vote share."""
    return votes.groupBy("norm", "is_debit").agg(
        F.min_by("category", F.struct(-F.col("votes"), F.col("first_seen"))).alias("category"),
        (F.max("votes") / F.sum("votes")).alias("confidence"),
        F.sum("votes").alias("total_votes"),
    )


def token_sets(votes: DataFrame) -> DataFrame:
    """Votes regrouped by token set (rows without tokens have no vector)."""
    return (
        votes.withColumn("token_set", F.array_sort(F.array_distinct(tokens_of_norm("norm"))))
        .filter(F.size("token_set") > 0)
        .groupBy("is_debit", "token_set", "category")
        .agg(F.sum("votes").alias("n"))
    )


def build_idf(votes: DataFrame) -> DataFrame:
    """K6: ``ln(N / df)`` over rows of both signs, no smoothing."""
    sets = votes.select(
        F.array_distinct(tokens_of_norm("norm")).alias("token_set"), F.col("votes").alias("n")
    ).filter(F.size("token_set") > 0)
    total = sets.agg(F.sum("n")).scalar()
    return (
        sets.select(F.explode("token_set").alias("token"), "n")
        .groupBy("token")
        .agg(F.sum("n").alias("df"))
        .select("token", "df", F.ln(total / F.col("df")).alias("idf"))
    )


def _vectors(sets: DataFrame, idf: DataFrame) -> DataFrame:
    """K7: binary x IDF vectors, one per distinct token set.

    ``terms`` lists (token, weight) rarest first, the global order both sides share.
    """
    weighted = (
        sets.select("token_set").distinct()
        .select("token_set", F.explode("token_set").alias("token"))
        .join(idf, "token")
        .groupBy("token_set")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("neg_idf"), "token"))).alias("t"))
    )
    terms = F.transform("t", lambda x: F.struct(x["token"].alias("token"), (-x["neg_idf"]).alias("weight")))
    weighted = weighted.select("token_set", terms.alias("terms"))
    return weighted.withColumn("length", _length("terms"))


def _length(terms: str) -> Column:
    squares = F.aggregate(F.col(terms), F.lit(0.0), lambda a, x: a + x["weight"] * x["weight"])
    return F.when(squares > 0, F.sqrt(squares)).otherwise(F.lit(1.0))


def build_docs(votes: DataFrame, idf: DataFrame) -> DataFrame:
    """K7: one row per (is_debit, token set) with its vector and its top labels."""
    return docs_of_sets(token_sets(votes), idf)


def docs_of_sets(sets: DataFrame, idf: DataFrame) -> DataFrame:
    """K7 from counted token sets (is_debit, token_set, category, n)."""
    top = Window.partitionBy("is_debit", "token_set").orderBy(F.desc("category"))
    labels = (
        sets.withColumn("_rank", F.row_number().over(top))
        .filter(F.col("_rank") <= TOP_K)
        .groupBy("is_debit", "token_set")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("category", F.least("n", F.lit(TOP_K)).cast("int").alias("n"))),
                asc=False,
            ).alias("l")
        )
    )
    repeated = F.flatten(F.transform("l", lambda x: F.array_repeat(x["category"], x["n"])))
    return labels.select(
        "is_debit", "token_set", F.slice(repeated, 1, TOP_K).alias("labels")
    ).join(_vectors(sets, idf), "token_set")


def build_index(history: DataFrame, history_order: str = "global") -> CategoryIndex:
    """The index of a history, each table written once."""
    votes = _written(count_votes(history, history_order), "votes")
    idf = _written(build_idf(votes), "idf")
    return CategoryIndex(votes, idf, _written(build_docs(votes, idf), "docs"))


def index_add(index: CategoryIndex, added: DataFrame, history_order: str = "global") -> CategoryIndex:
    """Newly labelled rows become exact votes; the vectors stay as built."""
    fresh = count_votes(added, history_order)
    merged = (
        index.votes.unionByName(fresh)
        .groupBy("norm", "is_debit", "category")
        .agg(F.sum("votes").alias("votes"), F.min("first_seen").alias("first_seen"))
    )
    return CategoryIndex(merged, index.idf, index.docs)


def query_keys(df: DataFrame) -> DataFrame:
    """The distinct (norm, is_debit) keys that need a lookup; each is scored once."""
    return df.select(norm("description").alias("norm"), is_debit("amount").alias("is_debit")).distinct()


def query_vectors(keys: DataFrame, idf: DataFrame) -> DataFrame:
    """K8: term-frequency x IDF vectors of query keys; unseen tokens weigh nothing.

    ``gain`` is what a shared token adds to the dot product with a document.
    """
    bags = (
        keys.select("norm", "is_debit", F.explode(tokens_of_norm("norm")).alias("token"))
        .groupBy("norm", "is_debit", "token")
        .agg(F.count("*").alias("tf"))
        .join(idf, "token")
        .groupBy("norm", "is_debit")
        .agg(
            F.array_sort(
                F.collect_list(F.struct((-F.col("idf")).alias("neg_idf"), F.col("token"), F.col("tf")))
            ).alias("t")
        )
    )
    terms = F.transform(
        "t",
        lambda x: F.struct(
            x["token"].alias("token"),
            (-x["neg_idf"] * x["tf"]).alias("weight"),
            (x["neg_idf"] * x["neg_idf"] * x["tf"]).alias("gain"),
        ),
    )
    vec = bags.select("norm", "is_debit", terms.alias("q_terms"))
    return vec.withColumn("q_length", _length("q_terms")).withColumn(
        "gains", F.map_from_entries(F.transform("q_terms", lambda x: F.struct(x["token"], x["gain"])))
    )


def _prefix_size(terms: Column, length: Column, threshold: float) -> Column:
    """How many leading terms a match of at least ``threshold`` must touch.

    The terms after the prefix have a norm below ``threshold * length``, so by
    Cauchy-Schwarz two vectors sharing only those cannot reach the threshold.
    """
    limit = (threshold * length) ** 2 * (1 - EPS)
    state = F.aggregate(
        F.reverse(terms),
        F.struct(F.lit(0.0).alias("sq"), F.lit(0).alias("dropped"), F.lit(True).alias("open")),
        lambda a, x: F.struct(
            (a["sq"] + x["weight"] * x["weight"]).alias("sq"),
            F.when(a["open"] & (a["sq"] + x["weight"] * x["weight"] < limit), a["dropped"] + 1)
            .otherwise(a["dropped"])
            .alias("dropped"),
            (a["open"] & (a["sq"] + x["weight"] * x["weight"] < limit)).alias("open"),
        ),
    )
    return F.size(terms) - state["dropped"]


def _score(pairs: DataFrame) -> DataFrame:
    """Cosine of each joined pair, kept only at the first token the two share.

    Every pair meets once per shared join token; the first one in rarity order is the
    one both prefix arguments guarantee, so this removes repeats without a shuffle.
    """
    shared = F.filter("terms", lambda x: F.map_contains_key(F.col("gains"), x["token"]))
    dot = F.aggregate(shared, F.lit(0.0), lambda a, x: a + F.element_at(F.col("gains"), x["token"]))
    return (
        pairs.withColumn("_first", F.get(shared, F.lit(0))["token"])
        .filter("_first = token")
        .withColumn(
            "similarity",
            F.round(dot / (F.col("q_length") * F.col("length")), SIMILARITY_DIGITS),
        )
        .drop("_first")
    )


def fuzzy_scores(queries: DataFrame, docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """K9: all (query, document) pairs of at least ``min_similarity``, exactly.

    Only the rare leading tokens of each side are joined, so a token found in a third
    of all rows creates work only where it is among the rarest of a description.
    """
    doc_side = docs.withColumn(
        "token",
        F.explode(
            F.transform(
                F.slice("terms", F.lit(1), _prefix_size(F.col("terms"), F.col("length"), min_similarity)),
                lambda x: x["token"],
            )
        ),
    )
    query_side = queries.withColumn(
        "token",
        F.explode(
            F.transform(
                F.slice("q_terms", F.lit(1), _prefix_size(F.col("q_terms"), F.col("q_length"), min_similarity)),
                lambda x: x["token"],
            )
        ),
    ).select("norm", "is_debit", "q_length", "gains", "token")
    return (
        _score(query_side.join(doc_side, ["is_debit", "token"]))
        .filter(F.col("similarity") >= min_similarity)
        .select("norm", "is_debit", "token_set", "similarity", "labels")
    )


def _top_rows(scored: DataFrame, k: int) -> DataFrame:
    """The k best neighbour rows per query, (similarity, category) descending."""
    best = Window.partitionBy("norm", "is_debit").orderBy(F.desc("similarity"), F.desc("category"))
    return (
        scored.select("norm", "is_debit", "similarity", F.explode("labels").alias("category"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )


def _band(length: Column) -> Column:
    return F.floor(F.log2(length) * BANDS_PER_OCTAVE).cast("int")


def _postings(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.explode("terms").alias("_t")).select(
        "is_debit", F.col("_t.token").alias("token"), F.col("_t.weight").alias("weight"),
        "token_set", "terms", "length", "labels",
    )


def fuzzy_topk(queries: DataFrame, docs: DataFrame, k: int = TOP_K) -> DataFrame:
    """The exact ``k`` (at most 3) nearest neighbour rows of every query.

    A document whose first shared token (rarity order) is ``t`` gains at most the sum of
    the query's gains from ``t`` on, so its similarity is at most that sum divided by
    both lengths: among the documents of one token only *short* vectors can matter.

    1. The shortest documents of each token give every query a floor: the similarity of
       its k-th row so far.
    2. Each (query, token) then joins just the length bands that can still beat the
       floor. Hot tokens gain little, so their bands end early; none is ever joined whole
       unless its documents really compete.

    A token present in every row has weight 0; only the highest labels per sign matter
    there, and they are its shortlist.
    """
    postings = _postings(docs)
    # Rank label rows, not documents: a zero-weight token orders by category alone.
    shortest = Window.partitionBy("is_debit", "token").orderBy(
        F.when(F.col("weight") > 0, F.col("length")).otherwise(F.lit(0.0)), F.desc("top_label"), "token_set"
    )
    ranked = (
        postings.withColumn("top_label", F.get("labels", F.lit(0)))
        .withColumn("_rank", F.row_number().over(shortest))
        .filter(F.col("_rank") <= k)
    )
    shortlist = ranked.drop("_rank", "top_label")
    # Documents beyond the shortlist are at least this long.
    beyond = (
        ranked.filter((F.col("_rank") == k) & (F.col("weight") > 0))
        .select("is_debit", "token", F.col("length").alias("next_length"))
    )
    q_rows = queries.select(
        "norm", "is_debit", "q_length", "gains", F.posexplode("q_terms").alias("pos", "_t"), "q_terms"
    ).select(
        "norm", "is_debit", "q_length", "gains", F.col("_t.token").alias("token"),
        F.aggregate(
            F.slice("q_terms", F.col("pos") + 1, F.size("q_terms")), F.lit(0.0), lambda a, x: a + x["gain"]
        ).alias("reach"),
    )
    near = _pairs(q_rows, shortlist, ["is_debit", "token"])
    seed = near.groupBy("norm", "is_debit", "token_set").agg(
        F.first("similarity").alias("similarity"), F.first("labels").alias("labels")
    )
    floor = (
        _top_rows(seed, k).groupBy("norm", "is_debit")
        .agg(F.count("*").alias("found"), F.min("similarity").alias("floor"))
        .filter((F.col("found") == k) & (F.col("floor") > 0))
    )
    # The floor is rounded, so it may exceed the true value by half a unit of its last digit.
    unit = 10.0**-SIMILARITY_DIGITS
    longest = F.least(
        F.col("max_length"),
        F.when(
            F.col("floor") > 2 * unit,
            F.col("reach") / (F.col("q_length") * (F.col("floor") - unit)) * (1 + EPS),
        ).otherwise(F.col("max_length")),
    )
    open_rows = (
        q_rows.join(floor, ["norm", "is_debit"])
        .crossJoin(docs.agg(F.max("length").alias("max_length")))  # one row
        .withColumn("longest", longest)
        .drop("max_length")
        .join(beyond, ["is_debit", "token"])
        .filter(F.col("longest") >= F.col("next_length"))
        .withColumn("band", F.explode(F.sequence(_band(F.col("next_length")), _band(F.col("longest")))))
    )
    banded = postings.withColumn("band", _band(F.col("length")))
    far = _pairs(open_rows, banded, ["is_debit", "token", "band"]).filter(
        (F.col("length") <= F.col("longest")) & (F.col("similarity") >= F.col("floor"))
    )
    found = (
        seed.unionByName(far.select("norm", "is_debit", "token_set", "similarity", "labels"))
        .groupBy("norm", "is_debit", "token_set")
        .agg(F.first("similarity").alias("similarity"), F.first("labels").alias("labels"))
    )
    return _top_rows(found, k)


def _pairs(q_rows: DataFrame, doc_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Score joined pairs without the first-shared-token filter (bounds differ per token)."""
    gained = F.transform("terms", lambda x: F.coalesce(F.element_at(F.col("gains"), x["token"]), F.lit(0.0)))
    dot = F.aggregate(gained, F.lit(0.0), lambda a, x: a + x)
    return q_rows.join(doc_rows, keys).withColumn(
        "similarity", F.round(dot / (F.col("q_length") * F.col("length")), SIMILARITY_DIGITS)
    )


def consensus(top: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Queries whose best neighbour clears the gate and whose neighbours agree."""
    return (
        top.groupBy("norm", "is_debit")
        .agg(
            F.max("similarity").alias("confidence"),
            F.min("category").alias("category"),
            F.max("category").alias("_other"),
        )
        .filter((F.col("confidence") >= min_similarity) & (F.col("category") == F.col("_other")))
        .drop("_other")
    )


def fuzzy_lookup(keys: DataFrame, index: CategoryIndex, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """K8-K11 for query keys: category and confidence where the gate passes.

    The threshold join settles every query that cannot pass (no strong neighbour, or
    strong neighbours that differ) and every query with three strong rows. Only the
    rest need weaker neighbours.
    """
    queries = query_vectors(keys, index.idf)
    strong = _top_rows(fuzzy_scores(queries, index.docs, min_similarity), TOP_K)
    verdict = strong.groupBy("norm", "is_debit").agg(
        F.count("*").alias("rows"),
        F.max("similarity").alias("confidence"),
        F.min("category").alias("category"),
        F.max("category").alias("_other"),
    ).filter(F.col("category") == F.col("_other"))
    settled = verdict.filter(F.col("rows") == TOP_K).select("norm", "is_debit", "confidence", "category")
    thin = queries.join(verdict.filter(F.col("rows") < TOP_K).select("norm", "is_debit"), ["norm", "is_debit"], "left_semi")
    return settled.unionByName(
        consensus(fuzzy_topk(thin, index.docs), min_similarity).select(*settled.columns)
    )


def key_answers(keys: DataFrame, index: CategoryIndex) -> DataFrame:
    """Exact, else fuzzy answer per (norm, is_debit) key; at most one row per key.

    ``keys`` limits the fuzzy part to what is asked; exact answers are all returned, the
    final join on the key drops the unused ones.
    """
    exact = build_exact(index.votes).select("norm", "is_debit", "category", "confidence")
    open_keys = keys.join(exact, ["norm", "is_debit"], "left_anti")
    fuzzy = fuzzy_lookup(open_keys, index).select(*exact.columns)
    return exact.withColumn("found_by", F.lit("exact")).unionByName(
        fuzzy.withColumn("found_by", F.lit("fuzzy"))
    )


def lookup(df: DataFrame, index: CategoryIndex) -> DataFrame:
    """Exact category, else fuzzy, else none, with confidence and source.

    Rows meet the answers in one join, so a merchant holding a third of all rows is an
    ordinary skewed join side that adaptive execution can split.
    """
    answers = key_answers(query_keys(df), index).withColumnRenamed("category", "found_category")
    rows = df.withColumn("norm", norm("description")).withColumn("is_debit", is_debit("amount"))
    return rows.join(answers, ["norm", "is_debit"], "left").select(
        *df.columns, "found_category", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "found_by"
    )
