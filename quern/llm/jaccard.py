"""Operator 10: n-gram Jaccard join by PartEnum signatures.

Documents are sets of word n-grams. Sizes are cut into bands so that linked sets lie in one band or in
neighbours. For a pair of neighbouring bands the Hamming distance of linked sets is at most k. The n-gram domain is hashed
into n1 = k // 2 + 1 parts, so in some part linked sets differ by one member at most. Each part is cut in three, and
all subsets of two of the three are enumerated: one of them has the same members in both sets. Its content, with its number, is a signature.
A subset without members says nothing and is not sent. With ``spare`` parts more than n1, sets that have empty subsets in at most
``spare`` parts still share a subset with members with each of their partners; other sets send, besides, the signatures of further
hashings of the domain, up to the first that suits them. Of two linked sets the one that stops first shares that hashing with the other, so no link
is missed. Where k is 0, linked sets are equal, and the whole set is the signature. Each candidate is verified exactly.

Keys are 64-bit hashes of sets, so copies are one item from the start.

Cases: null or empty text, or no word: size 0, linked with nothing; fewer than n words: one n-gram, the whole
sequence; repeated rows are copies; a null doc_id takes part in no link and has a null component; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import links
from quern.llm.common import Scratch, alone, mix64, release_shuffles, remembered, spread, u64, utf8

#: Distinct words whose hashes a worker remembers; beyond it the memory is emptied, which changes speed alone.
WORD_CACHE = 300_000
#: Keys of sets that a task remembers.
SEEN = 500_000
#: Hashings of the domain that a set may need.
HASHINGS = 16
_SALT = u64(1010, HASHINGS)


@functools.lru_cache(8)
def _factors(n: int) -> np.ndarray:
    return u64(7 * n + 1, n) | np.uint64(1)


@remembered
@functools.lru_cache(2)
def shingler_of(n: int) -> Shingler:
    """One per Python worker: the hashes that it remembers serve all of the worker's tasks."""
    return Shingler(n)


class Shingler:
    def __init__(self, n: int):
        self.n, self.words = n, {}

    def __call__(self, text: bytes) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the n-grams of lower-cased (A-Z) words between white space."""
        words, known = text.lower().split(), self.words
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > WORD_CACHE:
            known.clear()
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in words], np.uint64)
        n = min(self.n, len(h))
        f = _factors(n)
        g = h[: len(h) - n + 1] * f[0]
        for i in range(1, n):
            g = g + h[i : len(h) - n + 1 + i] * f[i]
        g = mix64(g)
        g.sort()
        return g[np.concatenate(([True], g[1:] != g[:-1]))]


class PartEnum:
    """Signatures for links of Jaccard similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.top = num, den, [0]  # top[i]: largest size of band i

    def band(self, size: int) -> int:
        while self.top[-1] < size:
            self.top.append((self.top[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.top, size))

    def parts(self, tag: int) -> tuple[int, int]:
        """(number of parts, spare ones) for sets of bands tag - 1 and tag; no parts if linked sets are equal."""
        while len(self.top) <= tag:
            self.band(self.top[-1] + 1)
        k = 2 * self.top[tag] * (self.den - self.num) // (self.den + self.num)
        spare = (k // 2 + 1) // 8
        return (k // 2 + 1 + spare, spare) if k else (0, 0)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        out, band = [np.zeros(0, np.uint64)], self.band(len(grams))
        content = mix64(grams ^ np.uint64(0x9E3779B97F4A7C15))
        for tag in (band, band + 1):
            parts, spare = self.parts(tag)
            if not parts:  # linked sets are equal: the whole set is the signature
                out.append(mix64(content.sum(keepdims=True, dtype=np.uint64) + mix64(np.array([tag << 4], np.uint64))))
            for hashing in range(HASHINGS if parts else 0):
                third = (mix64(grams + _SALT[hashing]) >> np.uint64(11)) % np.uint64(3 * parts)
                third = third.astype(np.int64)
                held = np.bincount(third, minlength=3 * parts).reshape(parts, 3)
                total = np.zeros(3 * parts, np.uint64)
                np.add.at(total, third, content)
                total = total.reshape(parts, 3)
                # The three subsets of two thirds: all but the first, the second, the last.
                some = (held.sum(1, keepdims=True) - held).ravel() > 0
                number = np.arange(3 * parts, dtype=np.uint64) << np.uint64(24) | np.uint64(tag << 4 | hashing)
                signature = mix64((total.sum(1, keepdims=True, dtype=np.uint64) - total).ravel() + mix64(number))
                enough = np.count_nonzero(~some.reshape(parts, 3).all(1)) <= spare
                if not enough and hashing == HASHINGS - 1:
                    some[:] = True  # tiny sets: their empty subsets go too
                out.append(signature[some])
                if enough:
                    break
        return np.concatenate(out)


def key_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) if len(grams) else 0


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text): documents linked at similarity num / den or more."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    docs = docs.select("doc_id", "text")
    nbytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = spread(spark, nbytes, 8 << 20)

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(shingler_of)
        shingles, enum, seen = shingler_of(n), PartEnum(num, den), set()
        send = links.Sender(buckets, TaskContext.get().partitionId())
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text"))):
                grams = shingles(text)
                key = key_of(grams)
                send.fact(doc, len(grams), key)
                if len(grams) and doc is not None and key not in seen:
                    if len(seen) >= SEEN:  # copies beyond it are sent again, which changes nothing
                        seen.clear()
                    seen.add(key)
                    s = enum(grams)
                    send.add(s, np.full(len(s), key, np.uint64))
                if send.full:
                    yield send.flush()
        yield send.flush()

    found = links.candidates(docs.mapInArrow(sets, links.PACKED), scratch)
    release_shuffles(spark)
    tasks = links.tasks_of(found)
    sizes = links.facts(found, "doc_id", "n_shingles", "key")
    # The document that stands for each set.
    stand = scratch.stage(sizes.where("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep")).coalesce(tasks), "stand")

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler_of(n)
        for b in batches:
            got = [(k, g.tobytes()) for k, t in zip(b.column("key").to_pylist(), utf8(b.column("text"))) if key_of(g := shingles(t)) == k & 0xFFFFFFFFFFFFFFFF]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([t for _, t in got], pa.binary())], ["id", "text"])

    # Sets of the candidates; another text under the same doc_id has another key and is left out.
    wanted = links.items(found).withColumnRenamed("id", "key").join(stand, "key").withColumnRenamed("rep", "doc_id")
    grams = scratch.stage(docs.join(wanted.hint("shuffle_hash"), "doc_id").select("key", "text").mapInArrow(chosen, "id long, text binary").dropDuplicates(["id"]).coalesce(tasks), "grams")
    release_shuffles(spark)
    comps = links.link(found, grams, lambda t: np.frombuffer(t, np.uint64), num, den, scratch)
    scratch.drop("grams")
    of_key = comps.select(F.col("id").alias("key"), F.col("component").alias("c")).join(stand, "key")
    least = of_key.groupBy("c").agg(F.min("rep").alias("component_id"))
    of_key = of_key.join(least, "c").select("key", "component_id")
    # Documents with one key are copies: hot keys, in joins that Spark can split.
    ids = sizes.join(stand.join(of_key, "key", "left").select("key", F.coalesce("component_id", "rep").alias("of_key")), "key", "left")
    comp = F.when(F.col("n_shingles") > 0, F.col("of_key")).otherwise(F.col("doc_id"))
    out = scratch.stage(ids.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), comp).alias("component_id")).coalesce(tasks), "out")
    scratch.only("out")
    return out


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, num=85, den=100)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM d),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles, s FROM g),
r AS (SELECT s, n_shingles, min(doc_id) AS rep FROM (SELECT doc_id, n_shingles, list_sort(s) AS s FROM n WHERE n_shingles > 0) GROUP BY s, n_shingles),
x AS (SELECT rep, n_shingles, unnest(s) AS t FROM r),
p AS (SELECT a.rep AS a, b.rep AS b, a.n_shingles + b.n_shingles AS both_, count(*) AS c
      FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n_shingles, b.n_shingles) >= 85 * greatest(a.n_shingles, b.n_shingles)
      GROUP BY ALL HAVING 100 * count(*) >= 85 * (a.n_shingles + b.n_shingles - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT v, root FROM (WITH RECURSIVE w AS (SELECT rep AS v, rep AS root FROM r UNION SELECT e.b, w.root FROM w JOIN e ON w.v = e.a) SELECT v, min(root) AS root FROM w GROUP BY v))
SELECT n.doc_id, n.n_shingles, coalesce(c.root, n.doc_id) AS component_id
FROM n LEFT JOIN r ON n.n_shingles > 0 AND r.s = list_sort(n.s) LEFT JOIN c ON c.v = r.rep
"""
