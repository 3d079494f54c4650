"""Operator 6: mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a hash of doc_id. In its source a document's copy e (0, 1, ...) begins at
e * source_size + the running total of sizes before it. A copy is served in packets of ``PACKET`` words at most; the virtual finish time of a packet is
the words of its source up to its end divided by the source's target. All packets of all sources are put in order of finish time, by
ranges over the whole cluster, and the order is cut where its running total reaches the budget: packets in ranges below the cut are taken, those
above are not, and the rows of the one range that the cut falls in are sorted. A source ends within about a packet of its target.

Running totals are taken in two steps, over hash buckets of a source and then inside each bucket, so a
source that holds most rows is spread over many tasks.

Cases: null text is a document of size 0, taken 0 times; null source is a source of its own, last; repeated doc_ids and
rows each count, ordered by text; an empty table gives an empty table; other columns pass through
``stream``, but those named size, copy, finish or taken are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, free

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2, "mix"
#: Words of a packet at most.
PACKET = 100
#: Rows of one hash bucket of a source or of one range of finish times, about; ranges at most.
BUCKET_ROWS, MOST_RANGES = 20_000, 100_000


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with weight and target.

    Water filling in closed form: by ascending cap / weight, a source stops at its cap as long as the
    cap is no more than its part of what the sources before it leave. One row per source, so one small task.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int"))
    df = sources.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * most)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.floor(F.sum("source_size").over(whole) * share)
    df = df.withColumn("left_", budget - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open_", F.sum("weight").over(after))
    full = F.col("cap") * F.col("open_") <= F.col("left_") * F.col("weight")
    df = df.withColumn("full_", F.min(full.cast("int")).over(by_fill.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    df = df.withColumn("rem_", F.max(F.when(~F.col("full_"), F.col("left_"))).over(whole)).withColumn("wide_", F.max(F.when(~F.col("full_"), F.col("open_"))).over(whole))
    rest = F.col("weight") * F.col("rem_") / F.col("wide_")
    return df.select("source", "source_size", "weight", F.when(F.col("full_"), F.col("cap").cast("double")).otherwise(rest.cast("double")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def placed(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """Rows (source, size, key, ...) with source_size, target and start: the words of the source before each row, first copies."""
    n = docs.count()
    buckets = max(16, -(-n // BUCKET_ROWS))
    df = docs.withColumn("b", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets, 32))  # ranges of the hash, so order by (b, key) is order by key
    sums = df.groupBy("source", "b").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("b")
    sums = sums.withColumn("before", F.sum("bucket_size").over(before) - F.col("bucket_size"))
    goals = targets(df.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    # Both tables have few rows for each source; null sources meet by null-safe equality.
    facts = sums.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "b", "before", "source_size", "target")
    tie = [c for c in ("doc_id", "text_hash", "nth") if c in df.columns]
    inside = Window.partitionBy("source", "b").orderBy("key", *tie)
    df = df.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    keep = [F.col(f"d.{c}") for c in docs.columns if c not in ("b", "inside")]
    return df.alias("d").join(facts.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.b") == F.col("f.b"))).select(*keep, "f.source_size", "f.target", (F.col("f.before") + F.col("d.inside")).alias("start"))


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    return docs.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))


def _nth(text_hash: str):
    """Number of a row among those of equal doc_id, source and text."""
    return F.row_number().over(Window.partitionBy("doc_id", "source", text_hash).orderBy(text_hash))


def _end(e: int, q) -> tuple:
    """(words, finish time) of packet q of copy e of a row."""
    to = F.least(F.col("size"), (q + 1) * PACKET)
    return to - q * PACKET, F.try_divide(e * F.col("source_size") + F.col("start") + to, F.col("target"))


def _range(finish, ranges: int):
    """Its range: from virtual time 2 on the last."""
    return F.floor(F.least(finish, F.lit(2.0)) * (ranges / 2)).cast("long")


def _packets():
    return F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / PACKET) - 1)).otherwise(F.array().cast("array<long>"))


def cut(rows: DataFrame, scratch: Scratch, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """Staged rows of ``placed`` with the words taken of each copy: taken_0, taken_1, ..."""
    placed_ = scratch.stage(placed(rows, share, most, weights, seed), "placed")
    total, packets = placed_.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("size") / PACKET)), F.lit(0))).first()
    budget, ranges = math.floor(total * share), min(MOST_RANGES, max(16, packets * most // BUCKET_ROWS))
    each = placed_.select("*", F.posexplode(F.array(*[F.lit(e) for e in range(most)])).alias("e", "copy")).drop("e").select("*", F.explode(_packets()).alias("q"))
    ends = [_end(e, F.col("q")) for e in range(most)]
    pick = lambda i: F.element_at(F.array(*[x[i] for x in ends]), F.col("copy") + 1)
    each = each.select("source", "key", "start", "copy", "q", pick(0).alias("words"), pick(1).alias("finish")).withColumn("range", _range(F.col("finish"), ranges))
    # The range that the budget ends in: at most MOST_RANGES + 1 rows in this window, two numbers to the driver.
    sums = each.groupBy("range").agg(F.sum("words").alias("words")).withColumn("to", F.sum("words").over(Window.orderBy("range")))
    last = sums.where(F.col("to") >= budget).orderBy("range").select("range", F.col("to") - F.col("words")).first()
    at, before = (last[0], last[1]) if last else (ranges + 1, 0)
    inside = each.where(F.col("range") == at).withColumn("to", F.sum("words").over(Window.partitionBy("range").orderBy("finish", "key", "start", "copy", "q").rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("got", F.least(F.greatest(F.lit(budget - before) - F.col("to") + F.col("words"), F.lit(0)), F.col("words"))).where("got > 0")
    inside = inside.groupBy("source", "start").agg(*[F.sum(F.when(F.col("copy") == e, F.col("got"))).alias(f"more_{e}") for e in range(most)])

    def below(e: int):
        return F.aggregate(_packets(), F.lit(0).cast("long"), lambda acc, q: acc + F.when(_range(_end(e, q)[1], ranges) < at, _end(e, q)[0]).otherwise(0))

    # Rows with words are told apart by source and start.
    same = F.col("p.source").eqNullSafe(F.col("i.source")) & (F.col("p.start") == F.col("i.start")) & (F.col("p.size") > 0)
    whole = placed_.select("*", *[below(e).alias(f"below_{e}") for e in range(most)]).alias("p").join(inside.alias("i"), same, "left")
    return whole.select("p.*", *[(F.col(f"below_{e}") + F.coalesce(f"more_{e}", F.lit(0))).cast("long").alias(f"taken_{e}") for e in range(most)]).drop(*[f"below_{e}" for e in range(most)])


def taken(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """Per document (doc_id, size, source_size, target, taken)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = _keyed(sized(docs.select("doc_id", "source", "text")), seed).select("doc_id", "source", "size", "key", F.xxhash64("text").alias("text_hash"))
    rows = scratch.stage(rows, "sizes")  # so that texts are read once
    copies = [F.col(f"taken_{e}") for e in range(most)]
    return cut(rows, scratch, share, most, weights, seed).select("doc_id", "size", "source_size", "target", sum(copies[1:], copies[0]).alias("taken"))


def stream(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself: docs' columns, size, copy, finish and taken, one row per copy that the cut leaves words, in order of finish time."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = _keyed(sized(docs.select("doc_id", "source", "text")), seed).select("doc_id", "source", "size", "key", F.xxhash64("text").alias("text_hash")).withColumn("nth", _nth("text_hash"))
    at = cut(scratch.stage(rows, "sizes"), scratch, share, most, weights, seed)
    finish = [F.try_divide(e * F.col("source_size") + F.col("start") + F.col("size"), F.col("target")) for e in range(most)]
    copies = F.array(*[F.struct(F.lit(e).alias("copy"), finish[e].alias("finish"), F.col(f"taken_{e}").alias("taken")) for e in range(most)])
    at = at.select("doc_id", "source", "text_hash", "nth", "size", F.explode(F.filter(copies, lambda c: c["taken"] > 0)).alias("c")).select("doc_id", "source", "text_hash", "nth", "size", "c.*")
    own = docs.drop("size", "copy", "finish", "taken")
    hash_, nth = free("text_hash", own.columns), free("nth", own.columns)
    numbered = own.withColumn(hash_, F.xxhash64("text")).withColumn(nth, _nth(hash_))
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col(f"d.{hash_}") == F.col("t.text_hash")) & (F.col(f"d.{nth}") == F.col("t.nth"))
    mixed = numbered.alias("d").join(at.alias("t"), same).select(*[F.col(f"d.`{c}`") for c in own.columns], "t.size", "t.copy", "t.finish", "t.taken")
    return mixed.repartitionByRange(F.col("finish"), F.col("doc_id")).sortWithinPartitions("finish", "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM d GROUP BY source),
fill AS (
  SELECT 0 AS round, (SELECT floor(sum(source_size) * 1.5)::BIGINT FROM s) AS rem, (SELECT sum(weight)::BIGINT FROM s) AS wide, []::VARCHAR[] AS full_, false AS done
  UNION ALL
  SELECT round + 1, rem - n.cap, wide - n.weight, list_concat(full_, n.names), n.cap IS NULL OR len(n.names) = 0
  FROM fill, LATERAL (
    SELECT coalesce(sum(2 * source_size), 0)::BIGINT AS cap, coalesce(sum(s.weight), 0)::BIGINT AS weight, coalesce(list(coalesce(source, chr(0))), []) AS names
    FROM s WHERE NOT list_contains(fill.full_, coalesce(source, chr(0))) AND 2 * source_size * fill.wide <= fill.rem * s.weight) n
  WHERE NOT done),
f AS (SELECT * FROM fill WHERE done),
g AS (SELECT source, source_size, CASE WHEN list_contains(f.full_, coalesce(source, chr(0))) THEN (2 * source_size)::DOUBLE ELSE (weight * f.rem)::DOUBLE / f.wide::DOUBLE END AS target FROM s, f),
p AS (SELECT d.doc_id, d.key, d.size, g.source_size, g.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, row_number() OVER (ORDER BY key, start) AS nr FROM p),
c AS (SELECT nr, key, start, e, q, least(size, (q + 1) * 100) - q * 100 AS words, (e * source_size + start + least(size, (q + 1) * 100))::DOUBLE / target AS finish
      FROM (SELECT *, unnest(range(0, (size + 99) // 100)) AS q FROM k), (VALUES (0), (1)) AS copies(e)),
t AS (SELECT nr, words, sum(words) OVER (ORDER BY finish, key, start, e, q ROWS UNBOUNDED PRECEDING) AS upto FROM c),
m AS (SELECT nr, sum(least(greatest((SELECT floor(sum(size) * 1.5) FROM d) - upto + words, 0), words))::BIGINT AS taken FROM t GROUP BY nr)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM k LEFT JOIN m USING (nr)
"""
