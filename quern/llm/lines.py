"""Operator 5: fuzzy line dedup by MinHash.

A line's item is its text without surrounding white space. With ``short``, as in op5_lines and the pipeline, every line with a
word counts; without it, lines under ``MIN_CHARS`` characters are left alone. A line's character 5-gram hashes fill ``BANDS * ROWS``
bins by one permutation, each bin keeping the least hash; empty bins take the value of a bin chosen by hash. A line under
5 characters is one gram that no other line has: it goes by its key alone, without a signature.
Bands of the signature give candidates (at similarity 0.8, all but 0.8 % of pairs), each verified by exact Jaccard
similarity of 5-gram sets. Of each component, found by distributed stars, the line of the smallest
(doc_id, line number) stays.

Cases: null text stays null and has 0 lines; a null doc_id keeps all its lines; repeated rows of one doc_id are one document (the
same lines go from each); equal lines inside a document are duplicates too; a document that loses every line keeps an
empty text; an empty table gives an empty table; other columns stay, but n_lines and n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import links
from quern.llm.common import Scratch, alone, free, mix64, release_shuffles, spread, u64, utf8

GRAM, BANDS, ROWS = 5, 16, 6
NUM, DEN = 80, 100
MIN_CHARS = 24
BINS = BANDS * ROWS
#: Keys of lines that a task remembers.
SEEN = 1_000_000
#: Characters whose signatures are made at once.
AT_ONCE = 400_000
#: Grams of these that are hashed at once: their numbers stay in a core's cache.
CACHED = 1 << 14
_F = u64(505, GRAM) | np.uint64(1)
_BAND = u64(506, BINS) | np.uint64(1)


def at_least(line: bytes, chars: int) -> bool:
    return len(line) >= chars and (len(line) >= 4 * chars or len(line.decode()) >= chars)


def lines_of(text: bytes, short: bool = False) -> list[tuple[int, bytes]]:
    """(line number, stripped line) of the lines that count."""
    least = 1 if short else MIN_CHARS
    return [(i, line) for i, line in enumerate(map(bytes.strip, text.split(b"\n"))) if at_least(line, least)]


def key_of(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line)


def _hashes(points: np.ndarray) -> np.ndarray:
    n = len(points) - GRAM + 1
    h = points[:n] * _F[0]
    for i in range(1, GRAM):
        h += points[i : n + i] * _F[i]
    return mix64(h)


def grams(line: bytes) -> np.ndarray:
    h = np.sort(_hashes(np.frombuffer(line.decode().encode("utf-32-le"), "<u4").astype(np.uint64)))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def signatures(lines: list[bytes]) -> np.ndarray:
    """Band hashes, one row for each line."""
    texts = [x.decode() for x in lines]
    sizes = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(len(lines) * BINS, none)
    place = np.repeat(np.arange(0, len(sig), BINS), sizes)
    over = (np.cumsum(sizes)[:-1, None] - np.arange(GRAM - 1, 0, -1)).ravel()  # grams that go over the end of a line
    n = len(points) - GRAM + 1
    for lo in range(0, n, CACHED):
        hi = min(lo + CACHED, n)
        h = _hashes(points[lo : hi + GRAM - 1].astype(np.uint64))
        h[over[slice(*np.searchsorted(over, (lo, hi)))] - lo] = none
        high = (h >> np.uint64(33)).astype(np.uint32)
        high -= high // np.uint32(BINS) * np.uint32(BINS)  # the remainder; numpy divides faster than it takes remainders
        np.minimum.at(sig, place[lo:hi] + high, h)
    sig = sig.reshape(-1, BINS)
    row, col = np.nonzero(sig == none)
    first, attempt = sig.copy(), 0
    while len(row):
        attempt += 1
        source = (mix64((col + BINS * attempt).astype(np.uint64)) % np.uint64(BINS)).astype(np.int64)
        got = first[row, source]
        have = got != none
        sig[row[have], col[have]] = got[have]
        row, col = row[~have], col[~have]
    bands = (sig * _BAND).reshape(-1, BANDS, ROWS).sum(2, dtype=np.uint64)
    return mix64(bands + mix64(np.arange(BANDS, dtype=np.uint64)))


def dedup(docs: DataFrame, scratch: Scratch | None = None, short: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) with duplicate lines taken out of text; n_lines and n_removed count the lines before and those taken. short: lines under ``MIN_CHARS`` too."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    docs = docs.select(own)
    narrow = docs.select("doc_id", "text")
    nbytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = spread(spark, nbytes, 8 << 20)

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        send, seen = links.Sender(buckets, TaskContext.get().partitionId()), set()
        wait, keys, size = [], [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text"))):
                if doc is None:
                    continue
                for i, line in lines_of(text, short):
                    k = key_of(line)
                    send.fact(doc, i, k)
                    if k not in seen and at_least(line, GRAM):
                        if len(seen) >= SEEN:  # copies beyond it are sent again, which changes nothing
                            seen.clear()
                        seen.add(k)
                        wait.append(line)
                        keys.append(k)
                        size += len(line)
                        if size > AT_ONCE:
                            send.add(signatures(wait).ravel(), np.repeat(np.array(keys, np.uint64), BANDS))
                            wait, keys, size = [], [], 0
                    if send.full:
                        yield send.flush()
        if wait:
            send.add(signatures(wait).ravel(), np.repeat(np.array(keys, np.uint64), BANDS))
        yield send.flush()

    found = links.candidates(narrow.mapInArrow(entries, links.PACKED), scratch)
    release_shuffles(spark)
    tasks = links.tasks_of(found)
    places = links.facts(found, "doc_id", "line", "key")
    firsts = scratch.stage(places.groupBy("key").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("n")).coalesce(tasks), "firsts")

    # Texts of the candidates, each from its first place.
    keys = links.items(found).withColumnRenamed("id", "key")
    wanted = keys.join(firsts, "key").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "key")).alias("lines"))

    def cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, ts = [], []
            for text, want in zip(utf8(b.column("text")), b.column("lines").to_pylist()):
                line = text.split(b"\n")
                for w in want:
                    t = line[w["line"]].strip() if w["line"] < len(line) else b""
                    if key_of(t) == w["key"] & 0xFFFFFFFFFFFFFFFF:
                        ks.append(w["key"])
                        ts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(ts, pa.binary())], ["id", "text"])

    texts = scratch.stage(narrow.join(wanted.hint("shuffle_hash"), "doc_id").select("text", "lines").mapInArrow(cut_out, "id long, text binary").dropDuplicates(["id"]).coalesce(tasks), "texts")
    release_shuffles(spark)
    comps = links.link(found, texts, grams, NUM, DEN, scratch)

    # What goes: each place of a repeated or linked line but the first of its component.
    many = firsts.join(comps.withColumnRenamed("id", "key"), "key", "left").where("n > 1 or component is not null").select("key", "first", F.coalesce("component", "key").alias("c"))
    best = many.join(many.groupBy("c").agg(F.min("first").alias("best")), "c").select("key", "best")
    gone = places.join(best, "key").where("not (doc_id = best.doc_id and line = best.line)")
    gone = scratch.stage(gone.groupBy("doc_id").agg(F.collect_set(F.struct("line", "key")).alias("gone")).coalesce(tasks), "gone")
    scratch.only("gone")
    release_shuffles(spark)

    mark = free("gone", own)

    def rebuilt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, removed = [], [], []
            for null, text, gone_ in zip(b.column("text").is_null().to_pylist(), utf8(b.column("text")), b.column(mark).to_pylist()):
                line = text.split(b"\n") if text else []
                drop = {g["line"] for g in gone_ or () if g["line"] < len(line) and key_of(line[g["line"]].strip()) == g["key"] & 0xFFFFFFFFFFFFFFFF}
                kept.append(None if null else b"\n".join([x for i, x in enumerate(line) if i not in drop]).decode())
                total.append(len(line))
                removed.append(len(drop))
            columns = [pa.array(kept, pa.string()) if c == "text" else b.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*own, "n_lines", "n_removed"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_lines long, n_removed long"])
    return docs.join(gone.withColumnRenamed("gone", mark).hint("shuffle_hash"), "doc_id", "left").select(*own, mark).mapInArrow(rebuilt, schema)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), short=True).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
