"""Operator 3: removal of repeated passages: every byte inside a string of ``LENGTH`` bytes that also starts earlier.

The column-wise construction (one symbol of each document a round, the collection's Burrows-Wheeler transform and
common prefixes rewritten sequentially each round) was not built or measured: it needs as many rounds as the longest document has
bytes, each over the whole external files. This module finds the same strings another way (see README).

Each string of LENGTH bytes has an anchor: its GRAM-byte piece of least hash, the first of equal ones. Equal strings have equal
anchors at equal offsets. Anchors lie about 35 bytes apart, each is the anchor of a run of neighbouring strings.
1. Chunks send the hashes of their distinct anchors by bucket; the bucket replies which occur twice or more.
2. For those, chunks send the bytes of the run's strings (distinct ones once, with their first place); the bucket hashes every string
   of every run and replies which of them have an earlier first place.
3. Chunks mark and take out the bytes.
What a bucket gets of an anchor is bounded by the number of chunks, however often it occurs.

Cases: null text is empty; texts shorter than LENGTH lose nothing; of rows with equal doc_id and equal place none is earlier;
a null doc_id comes before all others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chunks
from quern.llm.common import Scratch, mix64, release_shuffles, spread, u64

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
STEP = 1 << 20  # starts treated at once
CHUNK = 4 << 20
_BYTE = u64(303, 256) | np.uint64(1)
_MULT = int(u64(304, 1)[0]) | 5 & ~2  # odd


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    base |= 1
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.ones(n, np.uint64)
        done, step = 1, b
        while done < n:  # doubling
            k = min(done, n - done)
            p[done : done + k] = p[:k] * np.uint64(step)
            step = step * step % (1 << 64)
            done += k
        out.append(p)
    return out[0], out[1]


_POWERS: list[np.ndarray] = []


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of data[i:i+length] for each i."""
    if not _POWERS or len(_POWERS[0]) < len(data):
        _POWERS[:] = _powers(max(len(data), STEP + 2 * LENGTH), _MULT)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWERS[0][: len(data)], out=total[1:])
    n = len(data) - length + 1
    return mix64((total[length:] - total[:n]) * _POWERS[1][:n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents of a chunk (joined; ends: their ends): per anchor its place, hash, first and last start of its strings."""
    place, gram, lo_, hi_ = [], [], [], []
    for lo in range(0, len(data) - LENGTH + 1, STEP):
        part = data[lo : lo + STEP + LENGTH - 1]
        n = len(part) - LENGTH + 1
        h = window_hashes(part, GRAM)
        m = (h & np.uint64(0xFFFFFFFFFFE00000)) | np.arange(len(h), dtype=np.uint64)  # 43 bits of hash, 21 of place
        one, width = m, 1
        while 2 * width <= WINDOW:
            one = np.minimum(one[:-width], one[width:])
            width *= 2
        least = np.minimum(one[: n], one[WINDOW - width : WINDOW - width + n])
        at = (least & np.uint64(0x1FFFFF)).astype(np.int64)
        start = np.arange(n)
        doc_end = ends[np.searchsorted(ends, start + lo, side="right")]
        good = np.flatnonzero(start + lo + LENGTH <= doc_end)
        if not len(good):
            continue
        a = at[good]
        cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (np.diff(good) > 1))))
        last = np.append(cut[1:], len(good)) - 1
        place.append(a[cut] + lo)
        gram.append(h[a[cut]])
        lo_.append(good[cut] + lo)
        hi_.append(good[last] + lo)
    if not place:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    return np.concatenate(place), np.concatenate(gram), np.concatenate(lo_), np.concatenate(hi_)


def _load(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, sizes, blob = chunks.unpack(row)
    return ids, sizes, np.cumsum(sizes), np.frombuffer(blob, np.uint8)


def _by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices) of sorted hashes; a bucket's are in ascending order."""
    b = (hashes >> np.uint64(7)) % np.uint64(buckets)
    order = np.argsort(b, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(b) else []:
        yield int(b[part[0]]), part


def _first_pass(buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, _, ends, data = _load(row)
                gram = anchors(data, ends)[1]
                known, count = np.unique(gram, return_counts=True)
                bucket, payload = [], []
                for b, part in _by_bucket(known, buckets):
                    bucket.append(b)
                    payload.append(known[part].tobytes() + np.packbits(count[part] > 1).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([row["chunk"]] * len(bucket), pa.int64()), pa.array(payload, pa.binary())], ["bucket", "chunk", "payload"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Reply of a bucket: per chunk a bit for each of its anchors: found elsewhere or twice in the chunk."""
    hashes, twice = [], []
    for p in table.column("payload").to_pylist():
        n = len(p) * 8 // 65  # n hashes and n bits
        hashes.append(np.frombuffer(p, np.uint64, n))
        twice.append(np.unpackbits(np.frombuffer(p, np.uint8, -1, 8 * n), count=n).astype(bool))
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    s = every[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    flag = np.concatenate(twice)
    flag[order] |= same
    bits = [np.packbits(f).tobytes() for f in np.split(flag, np.cumsum([len(h) for h in hashes])[:-1])]
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array([1] * len(bits), pa.int32()), "bucket": table.column("bucket"), "payload": pa.array(bits, pa.binary())})


class _Runs:
    """The repeated anchors of a chunk, their distinct runs of strings and the first place of each."""

    def __init__(self, row: dict, replies: list[dict], buckets: int):
        self.ids, self.sizes, self.ends, self.data = _load(row)
        place, gram, lo, hi = anchors(self.data, self.ends)
        known, where = np.unique(gram, return_inverse=True)
        flag = np.zeros(len(known), bool)
        got = {r["bucket"]: r["payload"] for r in replies if r["kind"] == 1}
        for b, part in _by_bucket(known, buckets):
            flag[part] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=len(part)).astype(bool)
        keep = flag[where]
        self.place, self.gram, self.lo, self.hi = place[keep], gram[keep], lo[keep], hi[keep]
        doc = np.searchsorted(self.ends, self.place, side="right")
        self.doc, self.at = self.ids[doc], self.place - (self.ends - self.sizes)[doc]
        raw = self.data.tobytes()
        # Equal runs: anchor, offsets and bytes are the same.
        seen: dict[tuple, int] = {}
        self.run = np.array([seen.setdefault((p - a, raw[a : b + LENGTH]), len(seen)) for p, a, b in zip(self.place.tolist(), self.lo.tolist(), self.hi.tolist())], np.int64)
        order = np.lexsort((self.at, self.doc, self.run))
        self.first = order[np.flatnonzero(np.concatenate(([True], np.diff(self.run[order]) > 0)))] if len(order) else order
        self.raw = raw

    def by_bucket(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, first places in order of their runs)."""
        for b, part in _by_bucket(self.gram[self.first], buckets):
            yield b, self.first[part]


def _second_pass(buckets: int):
    def run(row: dict, replies: list[dict]) -> Iterator[pa.Table]:
        r = _Runs(row, replies, buckets)
        bucket, payload = [], []
        for b, f in r.by_bucket(buckets):
            bucket.append(b)
            head = np.stack((r.gram[f].view(np.int64), r.doc[f], r.at[f], r.place[f] - r.lo[f], r.hi[f] - r.lo[f]), 1)
            text = b"".join([r.raw[a : z + LENGTH] for a, z in zip(r.lo[f].tolist(), r.hi[f].tolist())])
            payload.append(len(f).to_bytes(8, "little") + chunks.squeeze(head.T.astype("<i8").tobytes() + text))
        yield pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array([row["chunk"]] * len(bucket), pa.int64()), "payload": pa.array(payload, pa.binary())})

    return run


def _earlier(table: pa.Table) -> pa.Table:
    """Reply of a bucket: per chunk and run a bit for each of its strings: it starts earlier somewhere."""
    heads, texts, counts = [], [], []
    for p in table.column("payload").to_pylist():
        n = int.from_bytes(p[:8], "little")
        raw = chunks.unsqueeze(p[8:])
        heads.append(np.frombuffer(raw, "<i8", 5 * n).reshape(5, n))
        texts.append(np.frombuffer(raw, np.uint8, -1, 40 * n))
        counts.append(n)
    head, text = np.concatenate(heads, 1), np.concatenate(texts)
    gram, doc, at, offset, more = head
    size = more + LENGTH
    begin = np.cumsum(size) - size
    strings = more + 1
    flags = np.zeros(int(strings.sum()), bool)
    owner = np.repeat(np.arange(len(gram)), strings)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    key = np.zeros(len(owner), np.uint64)
    # Hashes of the strings of whole runs, in pieces of bounded size.
    group = np.cumsum(size) // STEP
    for g in np.split(np.arange(len(gram)), np.flatnonzero(np.diff(group)) + 1):
        lo, hi = begin[g[0]], begin[g[-1]] + size[g[-1]]
        h = window_hashes(text[lo:hi], LENGTH)
        s = slice(int((np.cumsum(strings) - strings)[g[0]]), int(np.cumsum(strings)[g[-1]]))
        key[s] = h[begin[owner[s]] + nth[s] - lo]
    key ^= mix64(gram[owner].view(np.uint64) + (offset[owner] - nth).astype(np.uint64))
    place = np.lexsort((at, doc))  # order of places: equal ones get equal ranks
    rank = np.zeros(len(gram), np.int64)
    rank[place] = np.cumsum(np.concatenate(([0], (np.diff(doc[place]) != 0) | (np.diff(at[place]) != 0))))
    # A string's start is its anchor's place less its offset, so inside a key order by anchor is order by start.
    order = np.lexsort((rank[owner], key))
    k = key[order]
    head_of = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    least = np.repeat(rank[owner[order[head_of]]], np.diff(np.append(head_of, len(k))))
    flags[order] = rank[owner[order]] > least
    out, done = [], 0
    for n in counts:
        k = int(strings[done : done + n].sum())
        start = int(strings[:done].sum())
        out.append(np.packbits(flags[start : start + k]).tobytes())
        done += n
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array([2] * len(out), pa.int32()), "bucket": table.column("bucket"), "payload": pa.array(out, pa.binary())})


def _third_pass(buckets: int, texts: bool):
    def run(row: dict, replies: list[dict]) -> Iterator[pa.Table]:
        r = _Runs(row, replies, buckets)
        got = {x["bucket"]: x["payload"] for x in replies if x["kind"] == 2}
        starts = np.zeros(len(r.data) + 1, bool)
        for b, f in r.by_bucket(buckets):
            n = r.hi[f] - r.lo[f] + 1
            bits = np.unpackbits(np.frombuffer(got[b], np.uint8), count=int(n.sum())).astype(bool)
            where = np.repeat(r.lo[f] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            starts[where[bits]] = True
        # Later places of a run that is in the chunk already: all of its strings start earlier.
        if len(r.run):
            f = r.first[r.run]
            later = (r.doc != r.doc[f]) | (r.at != r.at[f])
            copy = ~later & (np.arange(len(f)) != f)
            for i in np.flatnonzero(later).tolist():
                starts[r.lo[i] : r.hi[i] + 1] = True
            for i in np.flatnonzero(copy).tolist():  # equal doc_id and place: as the first
                starts[r.lo[i] : r.hi[i] + 1] = starts[r.lo[f[i]] : r.hi[f[i]] + 1]
        step = np.zeros(len(r.data) + 1, np.int32)
        at = np.flatnonzero(starts)
        step[at] += 1
        np.subtract.at(step, np.minimum(at + LENGTH, len(r.data)), 1)
        gone = np.cumsum(step[:-1]) > 0
        rows: list[tuple] = []
        for doc, end, n in zip(r.ids.tolist(), r.ends.tolist(), r.sizes.tolist()):
            g = gone[end - n : end]
            removed = int(g.sum())
            kept = r.data[end - n : end][~g].tobytes() if removed else r.raw[end - n : end]
            runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if removed else 0
            rows.append((None if doc == chunks.NO_DOC else doc, n, removed, runs, hashlib.sha256(kept).hexdigest(), kept if texts else None))
        kinds = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()))
        for i in range(0, len(rows), 2048):
            yield pa.table({c: pa.array(v, t) for (c, t), v in zip(kinds, zip(*rows[i : i + 2048]))})

    return run


def dedup(docs: DataFrame, texts: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of docs (doc_id, text); kept (the bytes left) only with ``texts``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "repeats")
    packed = chunks.pack(docs, scratch, CHUNK)
    nbytes = packed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = spread(spark, nbytes, 6 << 20)
    reply = "chunk long, kind int, bucket int, payload binary"
    sent = packed.mapInArrow(_first_pass(buckets), "bucket int, chunk long, payload binary")
    one = scratch.stage(sent.groupBy("bucket").applyInArrow(_repeated, reply), "one")
    release_shuffles(spark)
    sent = chunks.with_replies(packed, one, _second_pass(buckets), "bucket int, chunk long, payload binary")
    two = scratch.stage(sent.groupBy("bucket").applyInArrow(_earlier, reply), "two")
    release_shuffles(spark)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = scratch.stage(chunks.with_replies(packed, one.unionByName(two), _third_pass(buckets, texts), out), "out")
    scratch.drop("chunks", "one", "two")
    return out


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("kept")
