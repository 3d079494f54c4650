"""Hybrid retrieval, batch first: every frame is keyed by query_id, and one query is a batch of one.

Queries are a stated set, checked to be small enough to broadcast (``small``); beyond that the lexical arm is a plain
equi join anyway, and the vector arm lets blocks of queries meet blocks of rows. Both arms take a stored index in place of the rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import english as E
from quern.functions import text as T
from quern.operators import positions, vectors
from quern.sources.shared import folder, stored

RRF_K = 60
MAX_BROADCAST_ROWS = 10_000
#: Queries up to which what the arms found is broadcast without counting it.
FEW_QUERIES = 2_000
#: Floors of kinds, in the order in which they are served.
FLOORS = (("en", 4), ("de", 4), ("es", 2), ("fr", 3))


def small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if it has few rows, else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def against(rows: DataFrame, few: DataFrame, block: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Every row with every one of few, a stated set: broadcast whole, or in blocks of about half of ``block`` rows where it has more."""
    n = few.count()
    if n <= block:
        return rows.crossJoin(F.broadcast(few))
    k = -(-2 * n // block)
    own = F.pmod(F.xxhash64(*few.columns), F.lit(k))
    return functools.reduce(DataFrame.unionByName, [rows.crossJoin(F.broadcast(few.where(own == i))) for i in range(k)])


def per_kind(limit: int) -> int:
    return max(8, (limit + 1) // 2)


def vector_arm(rows: DataFrame, queries: DataFrame, limit: int = 40, cap: int | None = None, index: vectors.VectorIndex | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, id, rank, dist): nearest rows (id, kind, embedding) for each query (query_id, vector): at most ``cap`` of a kind, at most limit.

    Zero vectors mean not embedded and are never near. With a stored index only the cells that queries probe are read.
    """
    k = cap or per_kind(limit)
    kept = index.search(queries, k, probes, limit=limit) if index else vectors.nearest(rows, queries, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "id", "rank", "dist")


def lexical_hits(source: DataFrame | positions.PositionIndex, queries: DataFrame) -> DataFrame:
    """(query_id, id, score): texts that hold any token of a query (query_id, text). source: rows (id, text), or their stored index.

    Cover density of an OR query: each matching place is a cover of its own and counts 0.1. Only places of the queries' tokens are exchanged.
    """
    q = positions.any_of(queries).select("query_id", "token")
    if isinstance(source, positions.PositionIndex):
        return positions.matched(source, q)
    places = source.select("id", F.explode(T.words(F.lower("text"))).alias("token")).join(small(q), "token")
    return places.groupBy("query_id", "id").agg((F.count(F.lit(1)) * 0.1).alias("score"))


def lexical_arm(source: DataFrame | positions.PositionIndex, queries: DataFrame, limit: int = 40) -> DataFrame:
    """(query_id, id, rank, score): the best of ``lexical_hits``."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return lexical_hits(source, queries).withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "id", "rank", "score")


def english_arm(rows: DataFrame, queries: DataFrame, limit: int = 40) -> DataFrame:
    """As ``lexical_arm`` with English stems and without stop words; cover density of an OR query: each place of a lexeme is a cover and counts 0.1."""
    asked = E.stemmed(queries.select("query_id", F.explode(F.array_distinct(E.tokens(F.col("text")))).alias("token"))).select("query_id", "lexeme").distinct()
    asked = stored(asked, folder(queries.sparkSession, "lexemes"))
    # Texts are read once; only counts of lexemes that a query asks for are exchanged.
    held = E.counted(rows, asked.select("lexeme").distinct())
    hits = held.join(small(asked), "lexeme").groupBy("query_id", "id").agg((F.sum("n") * 0.1).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "id", "rank", "score")


def answer_arm(hits: DataFrame, phrasings: DataFrame, answers: DataFrame, limit: int = 25) -> DataFrame:
    """(query_id, answer_id, rank, score): of phrasings (id, answer_id) that hits (query_id, id, score) found, the best of each published answer (id, status)."""
    from quern.operators.bank import published

    live = phrasings.join(published(answers).select(F.col("id").alias("answer_id")), "answer_id", "left_semi")
    best = hits.join(live, "id").groupBy("query_id", "answer_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "answer_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "answer_id", "rank", "score")


def explained(vector: DataFrame, lexical: DataFrame, net: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, id, vec, lex, fused, candidate, rerank): where each arm put what it found, its place after fusion, and whether it was reranked."""
    fused = fuse(vector, lexical)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    key = ["query_id", "id"]
    df = fused.withColumn("fused", place).join(vector.select(*key, F.col("rank").alias("vec")), key, "left").join(lexical.select(*key, F.col("rank").alias("lex")), key, "left")
    df = df.join(net.select(*key, F.lit(True).alias("candidate")), key, "left").join(scores.select(*key, F.col("score").alias("rerank")), key, "left")
    return df.select(*key, "vec", "lex", "fused", F.coalesce("candidate", F.lit(False)).alias("candidate"), "rerank")


def fuse(*arms: DataFrame) -> DataFrame:
    """(query_id, id, score): reciprocal rank fusion."""
    every = arms[0].select("query_id", "id", "rank")
    for a in arms[1:]:
        every = every.unionByName(a.select("query_id", "id", "rank"))
    return every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))


def scaled_floors(budget: int, floors=FLOORS) -> list[tuple[str, int]]:
    total = sum(n for _, n in floors)
    return list(floors) if budget >= total else [(k, max(1, int(n * budget / total + 0.5))) for k, n in floors]


def floor_of(budget: Column, floor: Column, floors=FLOORS) -> Column:
    """``scaled_floors`` of budgets that a table holds."""
    total = sum(n for _, n in floors)
    return F.when(budget >= total, floor).otherwise(F.greatest(F.lit(1), F.floor(floor * budget / total + 0.5))).cast("int")


def balance(ordered: DataFrame, budget: int, floors=FLOORS, final: list[Column] | None = None) -> DataFrame:
    """Of (query_id, id, kind, pos, ...) the picks of each query, with column place.

    Each kind in turn takes its first rows up to its floor, the rest goes by pos; the picks are then ordered by ``final`` or by pos.
    """
    own = scaled_floors(budget, floors)
    turn = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, (k, _) in enumerate(own)], F.lit(len(own)))
    floor = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in own], F.lit(0))
    in_kind = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("pos"))
    df = ordered.withColumn("_in", in_kind).withColumn("_tier", F.when(F.col("_in") <= floor, turn).otherwise(len(own) + 1))
    df = df.withColumn("_pick", F.row_number().over(Window.partitionBy("query_id").orderBy("_tier", "pos"))).where(F.col("_pick") <= budget)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*(final or ["pos"])))
    return df.withColumn("place", place).drop("_in", "_tier", "_pick")


def rerank(picks: DataFrame, texts: DataFrame, queries: DataFrame) -> DataFrame:
    """picks with column rerank: the stub backend's token Jaccard of query and passage."""
    q = small(queries.select("query_id", T.stub_tokens(F.col("text")).alias("_q")))
    p = texts.select("id", T.stub_tokens(F.col("text")).alias("_p"))
    return picks.join(p, "id").join(q, "query_id").withColumn("rerank", F.round(T.jaccard(F.col("_q"), F.col("_p")), 6)).drop("_q", "_p")


def best_by_tokens(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k rows (id, text) of most alike tokens for each query (query_id, text), by score, then id.

    Rows meet queries by tokens, and only tokens of queries are exchanged. Rows that share none have a score of 0: of those the first ids will do, as fewer than k rows come before them.
    """
    q = queries.select("query_id", T.stub_tokens(F.col("text")).alias("x")).select("query_id", "x", F.size("x").alias("nx"))
    d = rows.select("id", T.stub_tokens(F.col("text")).alias("y")).select("id", "y", F.size("y").alias("ny"))
    met = d.select("id", "ny", F.explode("y").alias("token")).join(small(q.select("query_id", "nx", F.explode("x").alias("token"))), "token")
    both = met.groupBy("query_id", "id", "nx", "ny").agg(F.count(F.lit(1)).alias("n"))
    shared = both.select("query_id", "id", (F.col("n") / F.greatest(F.col("nx") + F.col("ny") - F.col("n"), F.lit(1))).alias("score"))
    first = rows.select("id").orderBy("id").limit(2 * k).crossJoin(small(q.select("query_id")))  # 2k rows
    none = first.select("query_id", "id", F.lit(0.0).alias("score"))
    every = shared.unionByName(none).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, top: int = 12, limit: int = 40, index: positions.PositionIndex | None = None, cells: vectors.VectorIndex | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, place, id, kind, score, rerank): rows (id, kind, text, embedding), queries (query_id, text, vector).

    With the stored indexes of words and vectors each arm reads only what its queries touch.
    """
    few = queries.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES
    bounded = F.broadcast if few else lambda df: df  # at most FEW_QUERIES * 2 * limit rows of three numbers
    # Few rows for each query, stored because several steps read them: the arms run once.
    fused = stored(fuse(vector_arm(rows, queries, limit, index=cells, probes=probes), lexical_arm(index or rows, queries, limit)), folder(queries.sparkSession, "fused"))
    kinds = rows.select("id", "kind")
    # The arms give at most 2 * limit rows a query: their ids select from the large side.
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ordered = kinds.join(bounded(fused), "id").withColumn("pos", pos)
    wide = stored(balance(ordered, 3 * top).drop("place"), folder(queries.sparkSession, "wide"))
    scored = rerank(wide, rows.join(bounded(wide.select("id").distinct()), "id", "left_semi").select("id", "text"), queries)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank"), "pos"))
    return balance(scored.withColumn("pos", best), top).select("query_id", "place", "id", "kind", "score", "rerank")
