"""From signatures to verified links, for the near-duplicate operators.

An entry (signature, key) says that the item ``key`` (64 bits) has the signature; items that share one are candidates. Entries
travel packed by hash bucket, in the one exchange that also carries the facts (a, b, c) that an operator keeps of its rows.
Candidates are decided in two steps, neither of which writes down the pairs of a group:

1. A group of two is a pair. The hub of a larger group is its most popular member (popularity: the items in all of an item's groups; of many near
   copies of a text, the text itself is most popular). Each item is compared with the most popular of its hubs. What that links is one component.
2. A hub's cluster is all items of the groups that have it as hub, so it holds every candidate pair of those groups. A cluster that is not one
   component is compared whole, in blocks of ``BLOCK`` items: a matrix product bounds all intersections from above, and what it leaves
   possible between different components is verified exactly. Items in the hub's component are not compared with each other.

So no candidate pair whose link could matter is left out, and pairs inside a component, which cannot change it, cost nothing. A group of g
copies that link to their hub costs g comparisons; r items that do not link to it cost r * g entries of a matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, Unions, components, release_shuffles

#: Entries that a task gathers before it sends them on, and facts.
FLUSH, FACTS = 400_000, 50_000
#: Low bytes of a signature that travel: what they confuse inside a bucket is one more candidate, which is verified like any other.
SIGNED = 6
#: Items of a block, and columns of a block's matrix that hold one member each; as many more hold the rest by hash.
BLOCK, COLUMNS = 1024, 2048
#: Rows of a task that compares, and pairs of one item in a task.
ROWS, PAIRS = 2_000, 250
#: Candidates and facts of a task that writes what follows from them.
PER_FILE = 50_000
NO_ID = -(1 << 63)  # stands for a null among facts
PACKED = "bucket int, fact boolean, payload binary"


class Sender:
    """Packs entries and facts into rows (bucket, fact, payload); ``full`` says when to send."""

    def __init__(self, buckets: int, start: int):
        self.buckets, self.turn = buckets, start
        self.sigs, self.keys, self.facts, self.n = [], [], [], 0

    def add(self, sigs: np.ndarray, keys: np.ndarray) -> None:
        self.sigs.append(sigs)
        self.keys.append(keys)
        self.n += len(sigs)

    def fact(self, a: int | None, b: int, c: int) -> None:
        self.facts.append((NO_ID if a is None else a, b, c))

    @property
    def full(self) -> bool:
        return self.n >= FLUSH or len(self.facts) >= FACTS

    def flush(self) -> pa.RecordBatch:
        bucket, payload = [], []
        if self.n:
            s, k = np.concatenate(self.sigs), np.concatenate(self.keys)
            b = (s >> np.uint64(20)) % np.uint64(self.buckets)
            order = np.argsort(b, kind="stable")
            s, k, b = s[order], k[order], b[order]
            cut = np.flatnonzero(np.diff(b)) + 1
            low = s.view(np.uint8).reshape(-1, 8)[:, :SIGNED]
            payload = [x.tobytes() + y.tobytes() for x, y in zip(np.split(low, cut), np.split(k, cut))]
            bucket = b[np.concatenate(([0], cut))].tolist()
        fact = [False] * len(bucket)
        if self.facts:  # to any bucket, in turn
            a, b, c = zip(*self.facts)
            payload.append(np.array(a, np.int64).tobytes() + np.array(b, np.int64).tobytes() + np.array(c, np.uint64).tobytes())
            bucket.append(self.turn % self.buckets)
            fact.append(True)
            self.turn += 7919
        self.sigs, self.keys, self.facts, self.n = [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(fact, pa.bool_()), pa.array(payload, pa.binary())], ["bucket", "fact", "payload"])


def _table(kind: int, n: int, bucket: int, **columns) -> pa.Table:
    own = {"kind": pa.array(np.full(n, kind, np.int32)), "bucket": pa.array(np.full(n, bucket, np.int32))}
    for c, t in (("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("payload", pa.binary())):
        own[c] = columns[c] if c in columns else pa.nulls(n, t)
    return pa.table(own)


def _groups(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket: kind 0: pairs (a, b) that are a group; 1: the larger groups, packed; 2: (a: item, b: sum of their sizes); 3: facts."""
    bucket, out, sigs, keys = key[0].as_py(), [], [], []
    for fact, p in zip(table.column("fact").to_pylist(), table.column("payload").to_pylist()):
        if fact:
            a, b, c = np.frombuffer(p, np.int64).reshape(3, -1)
            out.append(_table(3, len(a), bucket, a=pa.array(a, mask=a == NO_ID), b=pa.array(b), c=pa.array(c)))
        else:
            n = len(p) // (SIGNED + 8)
            s = np.zeros((n, 8), np.uint8)
            s[:, :SIGNED] = np.frombuffer(p, np.uint8, SIGNED * n).reshape(n, SIGNED)
            sigs.append(s.view(np.uint64).ravel())
            keys.append(np.frombuffer(p, np.int64, n, SIGNED * n))
    if not sigs:
        return pa.concat_tables(out)
    s, k = np.concatenate(sigs), np.concatenate(keys)
    order = np.lexsort((k, s))
    s, k = s[order], k[order]
    fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])))
    s, k = s[fresh], k[fresh]
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    size = np.diff(np.append(start, len(s)))
    two = start[size == 2]
    pairs = np.unique(np.stack((k[two], k[two + 1]), 1), axis=0)
    out.append(_table(0, len(pairs), bucket, a=pa.array(pairs[:, 0]), b=pa.array(pairs[:, 1])))
    distinct = {k[x : x + n].tobytes() for x, n in zip(start[size > 2].tolist(), size[size > 2].tolist())}
    if distinct:
        sizes, members = np.array([len(g) // 8 for g in distinct], np.int64), np.frombuffer(b"".join(distinct), np.int64)
        out.append(_table(1, 1, bucket, payload=pa.array([len(sizes).to_bytes(8, "little") + sizes.tobytes() + members.tobytes()], pa.binary())))
        known, place = np.unique(members, return_inverse=True)
        weight = np.bincount(place, np.repeat(sizes, sizes)).astype(np.int64)
        out.append(_table(2, len(known), bucket, a=pa.array(known), b=pa.array(weight)))
    return pa.concat_tables(out)


def candidates(sent: DataFrame, scratch: Scratch) -> DataFrame:
    """Staged (kind, bucket, a, b, c, payload) of what ``Sender`` packed."""
    return scratch.stage(sent.groupBy("bucket").applyInArrow(_groups, "kind int, bucket int, a long, b long, c long, payload binary"), "candidates")


def tasks_of(found: DataFrame) -> int:
    """Tasks, and so files, of a table that has a row for each candidate or fact at most."""
    return max(1, -(-found.count() // PER_FILE))


def facts(found: DataFrame, a: str, b: str, c: str) -> DataFrame:
    return found.where("kind = 3").select(F.col("a").alias(a), F.col("b").alias(b), F.col("c").alias(c))


def items(found: DataFrame) -> DataFrame:
    """(id) of every candidate, once."""
    pairs = found.where("kind = 0")
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(found.where("kind = 2").select(F.col("a").alias("id"))).distinct()


def _hubs(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of a bucket's groups and the popularity of its items: distinct (g: hub, id, w: popularity of the hub)."""
    if not left.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("g", "id", "w")})
    p = left.column("payload")[0].as_py()
    n = int.from_bytes(p[:8], "little")
    sizes, members = np.frombuffer(p, np.int64, n, 8), np.frombuffer(p, np.int64, -1, 8 + 8 * n)
    ids, w = right.column("id").to_numpy(), right.column("w").to_numpy()
    order = np.lexsort((ids, w))  # by popularity, ties by id
    ids, w = ids[order], w[order]
    by_id = np.argsort(ids)
    rank = by_id[np.searchsorted(ids[by_id], members)]
    hub = np.repeat(np.maximum.reduceat(rank, np.cumsum(sizes) - sizes), sizes)
    pair = np.unique(hub * len(ids) + rank)
    hub, rank = pair // len(ids), pair % len(ids)
    hub, rank = hub[hub != rank], rank[hub != rank]
    return pa.table({"g": ids[hub], "id": ids[rank], "w": w[hub]})


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Sets (sorted distinct arrays) of Jaccard similarity num / den or more; an empty set is like nothing."""
    both = len(a) + len(b)
    if not len(a) or not len(b) or den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    s = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int(np.count_nonzero(s[1:] == s[:-1]))
    return den * shared >= num * (both - shared)


def link(found: DataFrame, texts: DataFrame, prepare: Callable[[bytes], np.ndarray], num: int, den: int, scratch: Scratch) -> DataFrame:
    """(id, component) of all items that have a link. found: from ``candidates``; texts: (id, text) of its items; prepare: a text to its set."""
    spark, tasks = found.sparkSession, tasks_of(found)
    weights = found.where("kind = 2").select("bucket", F.col("a").alias("id"), F.sum("b").over(Window.partitionBy("a")).alias("w"))
    hubs = found.where("kind = 1").select("bucket", "payload").groupBy("bucket").cogroup(weights.groupBy("bucket")).applyInArrow(_hubs, "g long, id long, w long")
    members = scratch.stage(hubs.groupBy("g", "id").agg(F.max("w").alias("w")).coalesce(tasks), "members")
    first = members.groupBy("id").agg(F.max(F.struct("w", "g")).alias("m")).select(F.col("m.g").alias("a"), F.col("id").alias("b"))
    tried = scratch.stage(first.unionByName(found.where("kind = 0").select("a", "b")).distinct().coalesce(tasks), "tried")
    release_shuffles(spark)
    edges = scratch.stage(compared(tried, texts, prepare, num, den).coalesce(tasks), "links")
    scratch.drop("tried")
    release_shuffles(spark)
    comps = components(edges, scratch, "cc")
    scratch.drop("links")
    more = scratch.stage(across(members, comps, texts, prepare, num, den, scratch, tasks).coalesce(tasks), "across")
    scratch.drop("members", "clusters")
    release_shuffles(spark)
    if more.isEmpty():
        return comps
    edges = comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
    out = components(edges, scratch, "cd")
    scratch.drop("cc-out", "across")
    return out


def _with_texts(dealt: DataFrame, ids: list[str], texts: DataFrame) -> DataFrame:
    """Rows of dealt (t, ...) and, for each task t, rows (t, id, text) of the items in its columns ids."""
    need = None
    for c in ids:
        part = dealt.select("t", F.col(c).alias("id_"))
        need = part if need is None else need.unionByName(part)
    got = need.distinct().join(texts.select(F.col("id").alias("id_"), F.col("text").cast("binary").alias("text")).hint("merge"), "id_")
    return dealt.unionByName(got, allowMissingColumns=True)


def _ready(table: pa.Table, prepare: Callable[[bytes], np.ndarray]) -> dict[int, np.ndarray]:
    own = table.filter(pc.is_valid(table.column("id_")))
    return {i: prepare(t) for i, t in zip(own.column("id_").to_pylist(), own.column("text").to_pylist())}


def _check(missing: set[int]) -> None:
    if missing:
        raise ValueError(f"no text for {len(missing)} of the items to compare, such as {min(missing)}")


def _edges(out: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([i for i, _ in out], pa.int64()), "b": pa.array([j for _, j in out], pa.int64())})


def compared(pairs: DataFrame, texts: DataFrame, prepare: Callable[[bytes], np.ndarray], num: int, den: int) -> DataFrame:
    """Links (a, b) among pairs (a, b) of items (id, text).

    Pairs are dealt by a, the item that many share, and by a salt of b where they are very many, so that no item's pairs
    meet in one task; each task gets a text once. A pair whose text is not among the items is an error.
    """
    tasks = max(1, -(-2 * pairs.count() // ROWS))
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > PAIRS)
    dealt = pairs.join(many, "a", "left").withColumn("salt", F.when(F.col("k").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / PAIRS))))
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("a", "salt"), F.lit(tasks)).cast("int").alias("t"))

    def run(table: pa.Table) -> pa.Table:
        ready = _ready(table, prepare)
        tried = [(i, j) for i, j in zip(table.column("a").to_pylist(), table.column("b").to_pylist()) if i is not None]
        _check({x for pair in tried for x in pair} - ready.keys())
        return _edges([(i, j) for i, j in tried if similar(ready[i], ready[j], num, den)])

    return _with_texts(dealt, ["a", "b"], texts).groupBy("t").applyInArrow(run, "a long, b long")


def possible(x: list[np.ndarray], y: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """[x, y] whether two sets may be similar: a matrix product bounds their intersection from above.

    Members of most sets have a column each, the others share columns by hash, which can only raise the bound.
    """
    sets = [*x, *y] if x is not y else x
    size = np.array([len(s) for s in sets])
    owner, every = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    known, place, count = np.unique(every, return_inverse=True, return_counts=True)
    column = np.full(len(known), -1)
    often = np.flatnonzero(count > 1)  # others are in one set alone
    often = often[np.argsort(-count[often], kind="stable")]
    column[often[:COLUMNS]] = np.arange(min(COLUMNS, len(often)))
    column[often[COLUMNS:]] = COLUMNS + (known[often[COLUMNS:]] % np.uint64(COLUMNS)).astype(np.int64)
    wide = min(len(often), COLUMNS) if len(often) <= COLUMNS else 2 * COLUMNS
    at = column[place]
    held = np.bincount(owner[at >= 0] * wide + at[at >= 0], minlength=len(sets) * wide).reshape(len(sets), wide).astype(np.float32) if wide else np.zeros((len(sets), 1), np.float32)
    m, n = (held, held) if x is y else (held[: len(x)], held[len(x) :])
    sx, sy = (size, size) if x is y else (size[: len(x)], size[len(x) :])
    return (m @ n.T) * (num + den) >= num * (sx[:, None] + sy[None, :])


def across(members: DataFrame, comps: DataFrame, texts: DataFrame, prepare: Callable[[bytes], np.ndarray], num: int, den: int, scratch: Scratch, files: int) -> DataFrame:
    """Links (a, b) between components inside clusters (g: hub, id), as far as they join some."""
    c = comps.select("id", F.col("component").alias("c"))
    every = members.select("g", "id").unionByName(members.select("g", F.col("g").alias("id")).distinct()).join(c, "id", "left").withColumn("c", F.coalesce("c", "id"))
    homes = members.select("g").distinct().join(c.withColumnRenamed("id", "g"), "g", "left").select("g", F.coalesce("c", "g").alias("home"))
    every = scratch.stage(every.join(homes, "g").withColumn("away", F.col("c") != F.col("home")).coalesce(files), "clusters")
    sizes = every.groupBy("g").agg(F.count_if("away").alias("r"), F.count_if(~F.col("away")).alias("l")).where("r > 0")
    sizes = sizes.select("g", F.ceil(F.col("r") / BLOCK).cast("int").alias("nr"), F.ceil(F.col("l") / BLOCK).cast("int").alias("nl"))
    cut = every.join(sizes, "g").withColumn("block", F.when(F.col("away"), F.pmod(F.xxhash64("id"), "nr")).otherwise(F.col("nr") + F.pmod(F.xxhash64("id"), "nl")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("away"), F.col("nr") + F.col("nl")).otherwise(F.col("nr")) - 1)))
    cut = cut.select("g", "id", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tasks = max(1, -(-every.join(sizes, "g", "left_semi").count() // ROWS))
    dealt = cut.withColumn("t", F.pmod(F.xxhash64("g", "i", "j"), F.lit(tasks)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        ready = _ready(table, prepare)
        columns = [table.column(x).to_pylist() for x in ("g", "i", "j", "block", "id", "c")]
        blocks: dict[tuple, tuple[list, list]] = {}
        for g, i, j, block, item, comp in zip(*columns):
            if g is not None:
                blocks.setdefault((g, i, j), ([], []))[block != i].append((item, comp))
        _check({item for sides in blocks.values() for side in sides for item, _ in side} - ready.keys())
        unions, out = Unions(), []
        for (_, i, j), (left, right) in sorted(blocks.items()):
            left, right = sorted(left), sorted(right) if i != j else None
            x = [ready[item] for item, _ in left]
            y = x if right is None else [ready[item] for item, _ in right]
            right = right or left
            if not left or not right:
                continue
            near = possible(x, y, num, den)
            cx, cy = np.array([c for _, c in left]), np.array([c for _, c in right])
            near &= cx[:, None] != cy[None, :]
            if i == j:
                near = np.triu(near, 1)
            for p, q in np.argwhere(near).tolist():
                (a, ca), (b, cb) = left[p], right[q]
                if unions.find(ca) != unions.find(cb) and similar(x[p], y[q], num, den):
                    unions.join(ca, cb)
                    out.append((a, b))
        return _edges(out)

    return _with_texts(dealt, ["id"], texts).groupBy("t").applyInArrow(run, "a long, b long")
