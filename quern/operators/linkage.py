"""Linking passages to the texts that contain them: shingle candidates, sequence verification, resolution.

A passage is indexed at every third 8-word shingle, a text is probed at every word; two shared shingles make a
candidate. Formulaic shingles are no hot key for long: passages per shingle are few, and the join is an
equi join whose larger partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.automata import Passage, matching_blocks

SHINGLE, STRIDE, MIN_HITS = 8, 3, 2
MAX_SHINGLES = 200_000  # of passages that are broadcast, 28 bytes each


def shingles(words: Column, stride: int = 1) -> Column:
    """Hashes of the 8-word runs at each stride, 96 bits of two independent functions: no strings are built or exchanged."""

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.slice(w, i, SHINGLE)).alias("a"), F.hash(F.slice(w, i, SHINGLE)).alias("b")))

    return T.let(words, of)


def candidates(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(passage_id, text_id, hits): hits counts places, as both sides' repeated shingles do.

    Where the passages' shingles are few they are broadcast, and only places that hit one are exchanged; else places are counted by text first.
    """
    p = passages.select("passage_id", F.explode(shingles(T.words(F.lower("text")), STRIDE)).alias("s")).groupBy("passage_id", "s.a", "s.b").agg(F.count(F.lit(1)).alias("np"))
    t = texts.select("text_id", F.explode(shingles(T.words(F.lower("text")))).alias("s")).select("text_id", "s.a", "s.b")
    if p.limit(MAX_SHINGLES + 1).count() <= MAX_SHINGLES:
        hits = t.join(F.broadcast(p), ["a", "b"]).withColumn("n", F.col("np"))
    else:
        hits = p.join(t.groupBy("text_id", "a", "b").agg(F.count(F.lit(1)).alias("nt")), ["a", "b"]).withColumn("n", F.col("np") * F.col("nt"))
    return hits.groupBy("passage_id", "text_id").agg(F.sum("n").alias("hits")).where(F.col("hits") >= MIN_HITS)


def permitted(pairs: DataFrame, passages: DataFrame, texts: DataFrame, slices: DataFrame) -> DataFrame:
    """Pairs whose text's edition is one that the passage's source may quote: passages (passage_id, source), texts (text_id, edition), slices (source, edition).

    A collection is linked with its own edition, a commentary with those it comments on; a source that slices do not name with none.
    """
    own = pairs.join(passages.select("passage_id", "source"), "passage_id").join(texts.select("text_id", "edition"), "text_id")
    return own.join(slices.distinct(), ["source", "edition"], "left_semi").select(pairs.columns)


def verified(pairs: DataFrame, min_coverage: float = 0.60, min_run: int = 8, min_block: int = 4) -> DataFrame:
    """(passage_id, text_id, coverage, start, span, matched) of pairs (passage_id, text_id, passage, text) that pass.

    Blocks are the longest common run of words, then the longest on either side of it, and so on; coverage is the share of the passage's words in blocks of min_block or more.
    A passage's automaton is built once for its pairs of a task, and each text is read along it in linear time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lru_cache(maxsize=256)(lambda passage: Passage(passage.split(" ")))
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                a, b = r.passage.split(" "), r.text.split(" ")
                blocks = [x for x in matching_blocks(a, b, automaton(r.passage)) if x[2] >= min_block]
                if not blocks:
                    continue
                longest = max(blocks, key=lambda x: x[2])
                coverage = sum(x[2] for x in blocks) / len(a)
                if coverage >= min_coverage and longest[2] >= min_run:
                    span = blocks[-1][1] + blocks[-1][2] - blocks[0][1]
                    out.append((r.passage_id, r.text_id, round(coverage, 4), blocks[0][1], span, " ".join(b[longest[1] : longest[1] + longest[2]])))
            yield pd.DataFrame(out, columns=["passage_id", "text_id", "coverage", "start", "span", "matched"])

    words = lambda c: F.array_join(T.words(F.lower(c)), " ")
    df = pairs.select("passage_id", "text_id", words("passage").alias("passage"), words("text").alias("text"))
    return df.mapInPandas(run, "passage_id long, text_id long, coverage double, start long, span long, matched string")


def resolved(matches: DataFrame) -> DataFrame:
    """Of each text's matches by (-coverage, start): one goes if more than half of it overlaps any kept one.

    Matches that no chain of overlaps connects don't touch each other, so each such island is resolved on its own.
    """
    order = Window.partitionBy("text_id").orderBy("start", "span", "passage_id")
    reach = F.max(F.col("start") + F.col("span")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = matches.withColumn("_new", F.when(reach > F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    xs = F.sort_array(F.collect_list(F.struct((-F.col("coverage")).alias("rank"), "start", "span", "passage_id", "coverage", "matched")))
    g = own.groupBy("text_id", "island").agg(xs.alias("xs"))
    kind = "array<struct<rank:double,start:bigint,span:bigint,passage_id:bigint,coverage:double,matched:string>>"

    def step(kept: Column, m: Column) -> Column:
        def clash(k: Column) -> Column:
            both = F.least(k["start"] + k["span"], m["start"] + m["span"]) - F.greatest(k["start"], m["start"])
            return both * 2 > m["span"]

        return F.when(F.exists(kept, clash), kept).otherwise(F.concat(kept, F.array(m)))

    return g.select("text_id", F.explode(F.aggregate("xs", F.array().cast(kind), step)).alias("m")).select("text_id", "m.passage_id", "m.coverage", "m.start", "m.span", "m.matched")
