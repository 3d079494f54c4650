"""A training-data pipeline over ``documents``: five stages, each one operator of quern.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import jaccard, lines, mixing, pieces, quality
from quern.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the content share reject go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model, keep_columns=True).where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike the first stays; documents left without any text go, n_chars follows the text."""
    done = lines.dedup(docs, short=True).where("n_removed = 0 or text rlike '[^ \\\\t-\\\\r]'")
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at five words and a similarity of 0.8 the one of the smallest doc_id stays; a null doc_id is in no group."""
    keep = jaccard.join(docs, n=5, num=80, den=100).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep.hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies in order of virtual finish time; of a copy that the cut divides, the side with more words decides."""
    return mixing.stream(docs).where("2 * taken >= size").select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("lang", "source"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("mixing", mixture), ("encoding", encoding)]

#: SQL can't express Viterbi decoding of a trained field, MinHash candidates or the encoder: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.stage(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
