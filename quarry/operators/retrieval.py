"""Lexical and vector retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators.fixpoint import stored


def exact_blockers(queries: DataFrame, cards: DataFrame, keys: list[str], query_id: str, card_id: str) -> DataFrame:
    """query, kind, card, n_cards: for each query and kind of key that some card has equal and not empty, the first such card and their number; cards with one key are not told one by one."""

    def tall(df: DataFrame, id_: str, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in keys])
        return df.select(F.col(id_).alias(name), F.explode(cells).alias("c")).select(name, "c.*").where("key is not null and key <> ''")

    known = tall(cards, card_id, "card").groupBy("kind", "key").agg(F.min("card").alias("card"), F.count_distinct("card").alias("n_cards"))
    return tall(queries, query_id, "query").join(known, ["kind", "key"]).select("query", "kind", "card", "n_cards")


#: Queries that are held against all cards at a time.
BLOCK = 10_000


def vector_topk(queries: DataFrame, cards: DataFrame, k: int) -> DataFrame:
    """query, card, sim, vec, rank: of every query (id, vec) its k nearest cards (id, vec) by cosine, itself left out.

    All cards are compared. Queries go out in blocks of about BLOCK, and each task keeps the k best of all its own cards for each
    query, without their vectors, so its memory does not grow with the cards, and what is shuffled are candidates and not pairs.
    Ids are unique. Vectors have one length; one without length has cosine 0.
    """
    blocks = queries.count() // BLOCK + 1
    out = None
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()  # about BLOCK vectors
        if not block:
            continue
        near = _near_block(cards, np.array([r.id for r in block]), _unit(np.array([r.vec for r in block], np.float64)), k)
        out = near if out is None else out.unionByName(near)
    if out is None:
        out = _near_block(cards.limit(0), np.zeros(0, np.int64), np.zeros((0, 1)), k)
    best = top_k(out, "query", k, F.desc("sim"), F.asc("card"))
    return best.join(cards.select(F.col("id").alias("card"), F.col("vec").cast("array<double>").alias("vec")), "card").select("query", "card", "sim", "vec", "rank")


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _near_block(cards: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    shared = cards.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        sims, cards = np.full((len(ids), k), -2.0), np.full((len(ids), k), np.iinfo(np.int64).max)
        for part in (b.slice(i, 1_000) for b in batches for i in range(0, b.num_rows, 1_000)):
            card, found = part.column("id").to_numpy(), _unit(np.array(part.column("vec").to_pylist(), np.float64))
            for a in range(0, len(ids), 1_000):
                sim = np.round(vectors[a : a + 1_000] @ found.T, 9)
                sim[ids[a : a + 1_000, None] == card[None, :]] = -2
                at = a + np.flatnonzero((sim >= sims[a : a + 1_000, -1:]).any(1))
                both = np.hstack([sims[at], sim[at - a]]), np.hstack([cards[at], np.broadcast_to(card, (len(at), len(card)))])
                order = np.lexsort((both[1], -both[0]))[:, :k]
                sims[at], cards[at] = (np.take_along_axis(x, order, 1) for x in both)
        row, place = np.nonzero(sims > -2)
        yield pa.record_batch({"query": pa.array(ids[row]), "card": pa.array(cards[row, place]), "sim": pa.array(sims[row, place])})

    return cards.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "query long, card long, sim double")


def _kept(sets: DataFrame) -> DataFrame:
    """sets as a table, as they are read several times and what makes them may be dear; few large pieces are dealt out to all cores."""
    cores = sets.sparkSession.sparkContext.defaultParallelism
    return stored(sets.repartition(cores) if sets.rdd.getNumPartitions() < cores else sets)


def _rare_first(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """card, nc, tokens (from the one that the fewest queries have on), found (how many queries have the first 1, 2, ... tokens, counted with repeats)."""
    spread = queries.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = cards.select(F.col("id").alias("card"), F.explode("tokens").alias("token")).join(spread, "token", "left")
    ranked = each.groupBy("card").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("t"))
    sums = F.transform("t", lambda _, i: F.aggregate(F.slice("t", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    return ranked.select("card", F.size("t").alias("nc"), F.transform("t", lambda x: x["token"]).alias("tokens"), sums.alias("found"))


def _verified(queries: DataFrame, cards: DataFrame, first: DataFrame, least: Column) -> DataFrame:
    """query, card, shared, score of pairs with a score of `least` (a column of first) or more that share one of their card's first tokens. first: card, nc, tokens, n_first, least.

    What is joined are the first tokens only; how many of them a pair shares and how many tokens are left bound its score, and pairs that the bound leaves are compared whole.
    """
    c = first.select("card", "nc", "n_first", least.alias("least"), F.explode(F.slice("tokens", F.lit(1), F.col("n_first"))).alias("token"))
    q = queries.select(F.col("id").alias("query"), F.size("tokens").alias("nq"), F.explode("tokens").alias("token"))
    met = q.join(c, "token").where((F.col("nq") >= F.col("least") * F.col("nc") - 1e-9) & (F.col("nc") >= F.col("least") * F.col("nq") - 1e-9))
    most = F.col("met") + F.least(F.col("nc") - F.col("n_first"), F.col("nq") - F.col("met"))
    hopeful = met.groupBy("query", "card", "nq", "nc", "n_first", "least").agg(F.count("*").alias("met")).where(most / (F.col("nq") + F.col("nc") - most) >= F.col("least") - 1e-9)
    whole = hopeful.join(queries.select(F.col("id").alias("query"), F.col("tokens").alias("__q")), "query").join(cards.select(F.col("id").alias("card"), F.col("tokens").alias("__c")), "card")
    shared = whole.withColumn("shared", F.size(F.array_intersect("__q", "__c")).cast("long"))
    return shared.select("query", "card", "shared", (F.col("shared") / (F.col("nq") + F.col("nc") - F.col("shared"))).alias("score"), "least").where("score >= least").drop("least")


def _enough(least: Column) -> Column:
    """How many first tokens of nc a pair of this score cannot all lack: it shares least * nc tokens."""
    return F.least(F.col("nc"), F.col("nc") - F.ceil(least * F.col("nc") - 1e-9) + 1).cast("int")


def token_pairs(queries: DataFrame, cards: DataFrame, least: float) -> DataFrame:
    """query, card, shared, score of all pairs with a Jaccard similarity of `least` (above 0) or more. Both: id, tokens (distinct). A card's most common tokens are not looked up, as none can do without a rarer one."""
    queries, cards = _kept(queries), _kept(cards)
    first = _rare_first(queries, cards).withColumn("n_first", _enough(F.lit(least)))
    return _verified(queries, cards, first, F.lit(least))


#: Queries that a card's rarest tokens find for its first bound.
SOUNDED = 200


def token_topk(queries: DataFrame, cards: DataFrame, k: int) -> DataFrame:
    """query, card, shared, score, rank: each card's k most similar queries that share a token with it, ties by query.

    The queries that a card's rarest tokens find give a bound: the k-th best of them. All that can reach it share a token that is not among
    the card's most common ones, and those alone are looked up.
    """
    queries, cards = _kept(queries), _kept(cards)
    ranked = stored(_rare_first(queries, cards))
    sounded = ranked.withColumn("n_first", F.greatest(F.lit(1), F.size(F.filter("found", lambda n: n <= SOUNDED))))
    bound = top_k(_verified(queries, cards, sounded, F.lit(0.0)), "card", k, F.desc("score"), F.asc("query")).groupBy("card").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    first = ranked.join(stored(bound), "card", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).withColumn("n_first", _enough(F.col("least")))
    return top_k(_verified(queries, cards, first, F.col("least")).where("shared > 0"), "card", k, F.desc("score"), F.asc("query"))


def top_k(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def mmr(shortlists: DataFrame, k: int, lam: float) -> DataFrame:
    """Greedy maximal marginal relevance over each query's shortlist (query, card, relevance, vec): query, card, place. Shortlists are bounded by their top-k."""

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["relevance", "card"], ascending=[False, True])
        vectors, relevance = _unit(np.array(g.vec.tolist(), np.float64)), g.relevance.to_numpy()
        chosen, nearest = [], np.zeros(len(g))
        left = np.ones(len(g), bool)
        while len(chosen) < min(k, len(g)):
            best = int(np.where(left, lam * relevance - (1 - lam) * nearest, -np.inf).argmax())
            cosine = vectors @ vectors[best]
            nearest = cosine if not chosen else np.maximum(nearest, cosine)
            chosen.append(best)
            left[best] = False
        return pd.DataFrame({"query": g["query"].iloc[:1].repeat(len(chosen)).values, "card": g.card.iloc[chosen].values, "place": range(1, len(chosen) + 1)})

    return shortlists.select("query", "card", "relevance", "vec").groupBy("query").applyInPandas(choose, "query long, card long, place int")
