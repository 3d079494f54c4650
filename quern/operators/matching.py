"""Matching questions against a bank of answers: candidates, best phrasing, decision ladder, alternatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAR, OVERRIDE, LEAST, CONFIDENT = 0.32, 0.9, 0.1, 0.5
MARGIN, WIDE_MARGIN, ALTERNATIVES = 0.05, 0.35, 3


def candidate_net(vector_hits: DataFrame, fused: DataFrame, first: int = 8, most: int = 20) -> DataFrame:
    """(query_id, id, pos): the first vector hits, then the fused order, each id once, at most ``most``."""
    a = vector_hits.where(F.col("rank") <= first).select("query_id", "id", F.lit(0).alias("tier"), F.col("rank").alias("p"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    b = fused.select("query_id", "id", F.lit(1).alias("tier"), order.alias("p"))
    once = a.unionByName(b).groupBy("query_id", "id").agg(F.min(F.struct("tier", "p")).alias("at"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id"))
    return once.select("query_id", "id", pos.alias("pos")).where(F.col("pos") <= most)


def best_by(df: DataFrame, keys: list[str], order: list, name: str = "_r") -> DataFrame:
    """The first row of each group in an order that leaves no ties."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) == 1).drop(name)


def decide(ranked: DataFrame, offline: bool = False) -> DataFrame:
    """(query_id, answer_id, score, outcome, confident, alternatives) of ranked (query_id, answer_id, score, nearest).

    nearest: distance of the nearest phrasing in the whole bank. Far and not overriding, or below the least score: a miss.
    """
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "answer_id"))
    df = ranked.withColumn("pos", pos)
    top = F.max(F.when(F.col("pos") == 1, F.col("score"))).over(Window.partitionBy("query_id"))
    margin = F.when(F.col("top") < CONFIDENT, WIDE_MARGIN).otherwise(MARGIN)
    df = df.withColumn("top", top).withColumn("near", (F.col("pos") > 1) & (F.col("top") - F.col("score") < margin))
    others = df.where("near").select("query_id", "pos", "answer_id")
    others = others.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("n") <= ALTERNATIVES)
    others = others.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "answer_id"))), lambda x: x["answer_id"]).alias("alternatives"))
    miss = F.lit(offline) | ((F.col("nearest") > FAR) & (F.col("score") < OVERRIDE)) | (F.col("score") < LEAST)
    first = df.where("pos = 1").join(others, "query_id", "left")
    served = ~miss
    return first.select("query_id", F.when(served, F.col("answer_id")).alias("answer_id"), "score", F.when(miss, "miss").otherwise("hit").alias("outcome"), (served & (F.col("score") >= CONFIDENT)).alias("confident"), F.when(served, F.coalesce("alternatives", F.array().cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>")).alias("alternatives"))
