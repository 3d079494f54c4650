"""Operator 12: centroid clustering by kd-tree filtering.

Vectors become integers, floor(1024 * x). Each partition cuts its vectors into blocks and builds a kd-tree of each block
once: a node holds its count, its componentwise sums and its bounding box. A round walks every tree from the root with
the centroids that can still be nearest: the candidate nearest to the middle of the box prunes each candidate that is
strictly farther from every point of the box; a node with one candidate left is assigned as a whole, by its count and sums; the
points of leaves with several are compared exactly. Blocks are rows of a table in the shared folder, so a round
is one job over it that gives a few numbers a task. Sums are exact whatever their size: they travel as 32-bit limbs.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out; a null vec_id is clustered but
starts no centroid; rows that repeat count each (repeated ids that tie for a start are in order of their components); fewer kept vectors than centroids give
fewer centroids; an empty table, or none kept, gives an empty table; components of any finite size are exact, distances and inertias beyond a
long come back as the largest long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, alone

DIMS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Vectors of a tree, and of a leaf at most.
BLOCK, LEAF = 4096, 32
#: Below FLOATS products and their sums are exact in double precision, below INTS in 64-bit integers; beyond, Python's integers.
FLOATS, INTS = 1 << 22, 1 << 26
LONGEST = (1 << 63) - 1


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of finite doubles, exactly: int64, or Python's integers where that is too small."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if not scaled.size or np.abs(scaled).max() < 1 << 62:
        return scaled.astype(np.int64)
    exact = [int(s) if np.isfinite(s) else int(v) * SCALE for s, v in zip(scaled.ravel().tolist(), x.ravel().tolist())]
    return np.array(exact, object).reshape(x.shape)


def bound(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in a type in which squared distances between them are exact."""
    kind = np.int64 if max(map(bound, arrays)) < INTS else object
    return [a.astype(kind) for a in arrays]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x from each row of c."""
    if max(bound(x), bound(c)) < FLOATS:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    x, c = fitting(x, c)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


class Tree:
    """A complete binary tree over rows of x, which it brings into the order of its leaves; nodes are in heap order."""

    def __init__(self, x: np.ndarray):
        n, self.depth = len(x), 0
        while n > LEAF << self.depth:
            self.depth += 1
        self.order = np.arange(n)
        for level in range(self.depth):
            cuts = self.bounds(n, level)
            for s, e in zip(cuts[:-1], cuts[1:]):
                rows = self.order[s:e]
                part = x[rows]
                v = part[:, int(np.argmax(part.max(0) - part.min(0)))]
                self.order[s:e] = rows[np.argsort(v, kind="stable")]
        self.x = x[self.order]
        starts = self.bounds(n, self.depth)[:-1]
        levels = [tuple(f.reduceat(self.x, starts, axis=0) for f in (np.minimum, np.maximum, np.add))]
        for _ in range(self.depth):
            lo, hi, total = levels[0]
            levels.insert(0, (np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), total[::2] + total[1::2]))
        self.low, self.high, self.total = (np.concatenate(part) for part in zip(*levels))

    @staticmethod
    def bounds(n: int, level: int) -> np.ndarray:
        """Where the nodes of a level begin, and n: each node is halved."""
        cuts = [0, n]
        for _ in range(level):
            cuts = [c for s, e in zip(cuts[:-1], cuts[1:]) for c in (s, (s + e) // 2)] + [n]
        return np.array(cuts, np.int64)

    def assign(self, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
        """Nodes assigned whole, as (heap index, start and end of their points, cluster) by level; and points of leaves, as (place, cluster)."""
        c, low, high = fitting(centroids, self.low, self.high)
        whole, single = [], []
        node, open_ = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        for level in range(self.depth + 1):
            cuts = self.bounds(len(self.x), level)
            lo, hi = low[node], high[node]
            off = ((2 * c[None] - (lo + hi)[:, None]) ** 2).sum(2)
            best = np.array([min(np.flatnonzero(o), key=lambda k: d[k]) for o, d in zip(open_, off)], np.int64)
            star = c[best][:, None]
            corner = np.where(c[None] > star, hi[:, None], lo[:, None])  # of the box, where the candidate does best against the star
            open_ = open_ & (((c[None] - star) * (c[None] + star - 2 * corner)).sum(2) <= 0)
            alone_ = open_.sum(1) == 1
            place = node - ((1 << level) - 1)
            whole.append((node[alone_], np.stack((cuts[place[alone_]], cuts[place[alone_] + 1]), 1), best[alone_]))
            node, open_, place = node[~alone_], open_[~alone_], place[~alone_]
            if not len(node):
                break
            if level < self.depth:
                node, open_ = np.stack((2 * node + 1, 2 * node + 2), 1).ravel(), np.repeat(open_, 2, axis=0)
                continue
            sizes = cuts[place + 1] - cuts[place]
            rows = np.repeat(cuts[place] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            d = squared(self.x[rows], centroids)
            d[~np.repeat(open_, sizes, axis=0)] = d.max() + 1 if d.dtype == object or d.max() < LONGEST else LONGEST
            single.append((rows, d.argmin(1)))  # the smaller number wins ties
        return whole, single

    def sums(self, centroids: np.ndarray) -> np.ndarray:
        """Of each centroid: the sums of its points' components, then their number."""
        out = np.zeros((len(centroids), self.x.shape[1] + 1), object)
        whole, single = self.assign(centroids)
        for nodes, cuts, cluster in whole:
            for node, (s, e), k in zip(nodes, cuts, cluster):
                out[k, :-1] += self.total[node].astype(object)
                out[k, -1] += int(e - s)
        for rows, cluster in single:
            for k in np.unique(cluster):
                own = rows[cluster == k]
                out[k, :-1] += self.x[own].sum(0).astype(object)
                out[k, -1] += len(own)
        return out

    def labels(self, centroids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.x), np.int64)
        whole, single = self.assign(centroids)
        for _, cuts, cluster in whole:
            for (s, e), k in zip(cuts, cluster):
                out[s:e] = k
        for rows, cluster in single:
            out[rows] = cluster
        return out

    def packed(self) -> tuple[bytes, bytes, bytes, bytes, int]:
        """Points, boxes and sums as bytes, and bytes of a component: 0 where they are Python's integers, written as text."""
        if self.x.dtype == object or bound(self.x) >= INTS:
            return json.dumps(self.x.tolist()).encode(), b"", b"", b"", 0
        size = 2 if bound(self.x) < 1 << 15 else 4
        return self.x.astype(f"<i{size}").tobytes(), self.low.astype(f"<i{size}").tobytes(), self.high.astype(f"<i{size}").tobytes(), self.total.astype("<i8").tobytes(), size

    @classmethod
    def unpacked(cls, x: bytes, low: bytes, high: bytes, total: bytes, size: int, dims: int) -> Tree:
        if not size:
            rows = json.loads(x)
            return cls(np.array(rows, np.int64 if max(abs(v) for r in rows for v in r) < 1 << 50 else object))
        tree = cls.__new__(cls)
        tree.x, tree.low, tree.high = (np.frombuffer(b, f"<i{size}").astype(np.int64).reshape(-1, dims) for b in (x, low, high))
        tree.total, tree.order, tree.depth = np.frombuffer(total, "<i8").reshape(-1, dims), np.arange(len(tree.x)), 0
        while len(tree.x) > LEAF << tree.depth:
            tree.depth += 1
        return tree


def limbs(v: int) -> list[int]:
    """v as digits of 32 bits with its sign, lowest first."""
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v:
        out.append(sign * (v & 0xFFFFFFFF))
        v >>= 32
    return out


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == dims) & fine)


def trees(vectors: DataFrame, scratch: Scratch, dims: int) -> DataFrame:
    """One row a block of kept vectors: its ids and its tree."""
    binary = ("ids", "x", "low", "high", "total")

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        ids, parts, n = [], [], 0

        def row(ids: list, x: np.ndarray) -> pa.RecordBatch:
            tree = Tree(x)
            *blobs, size = tree.packed()
            names = json.dumps([ids[i] for i in tree.order]).encode()
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.binary()) for v in (names, *blobs)), pa.array([size], pa.int32())], [*binary, "size"])

        for b in batches:
            values = b.column("embedding").flatten().to_numpy(zero_copy_only=False)
            parts.append(integers(values.reshape(-1, dims)))
            ids += b.column("vec_id").to_pylist()
            n += b.num_rows
            if n >= BLOCK:
                x = np.concatenate(parts)
                whole = n - n % BLOCK
                for lo in range(0, whole, BLOCK):
                    yield row(ids[lo : lo + BLOCK], x[lo : lo + BLOCK])
                ids, parts, n = ids[whole:], [x[whole:]], n - whole
        if n:
            yield row(ids, np.concatenate(parts))

    return scratch.stage(kept(vectors, dims).mapInArrow(build, ", ".join([*(f"{c} binary" for c in binary), "size int"])), "trees")


def opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[list, Tree]]:
    for i in range(batch.num_rows):
        ids, *blobs, size = (batch.column(c)[i].as_py() for c in ("ids", "x", "low", "high", "total", "size"))
        tree, names = Tree.unpacked(*blobs, size, dims), json.loads(ids)
        yield [names[j] for j in tree.order], tree


def next_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floor of each non-empty centroid's mean."""
    dims = centroids.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dims + 1), object)
        for b in batches:
            for _, tree in opened(b, dims):
                total += tree.sums(centroids)
        rows = [(k, d, i, v) for (k, d), whole in np.ndenumerate(total) for i, v in enumerate(limbs(int(whole)))]
        cluster, dim, limb, part = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in (cluster, dim, limb)), pa.array(part, pa.int64())], ["cluster", "dim", "limb", "part"])

    # The driver gets a few numbers for each component of each centroid.
    found = blocks.mapInArrow(run, "cluster int, dim int, limb int, part long").groupBy("cluster", "dim", "limb").agg(F.sum("part").alias("part")).collect()
    total = np.zeros((len(centroids), dims + 1), object)
    for r in found:
        total[r["cluster"], r["dim"]] += r["part"] << (32 * r["limb"])
    out = centroids.astype(object)
    for k, row in enumerate(total):
        if row[-1]:
            out[k] = [v // row[-1] for v in row[:-1]]
    return out.astype(np.int64) if bound(out) < 1 << 62 else out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the kept vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "kdmeans")
    blocks = trees(vectors, scratch, dims)
    first = kept(vectors, dims).where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    starts = first.orderBy("h", "embedding").limit(k).select("embedding").collect()  # k vectors
    schema = "vec_id long, cluster int, distance long"
    if not starts:
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = integers(np.array([r["embedding"] for r in starts], np.float64))
    for _ in range(rounds):
        centroids = next_centroids(blocks, centroids)

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, tree in opened(b, dims):
                label = tree.labels(centroids)
                far = np.zeros(len(label), object)
                for c in np.unique(label):
                    far[label == c] = squared(tree.x[label == c], centroids[c : c + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array([min(int(d), LONGEST) for d in far], pa.int64())], ["vec_id", "cluster", "distance"])

    placed = scratch.stage(blocks.mapInArrow(last, schema), "placed")
    inertia = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(c, min(inertia.get(c, 0), LONGEST), min(sum(inertia.values()), LONGEST), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    scratch.drop("trees")
    # Broadcast: a row for each of k centroids.
    return placed.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The rounds one after the other; rid tells repeated vec_ids apart."""
    nearest = "SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM k, {0}) GROUP BY rid"
    ctes = [
        "e AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64)",
        "k AS MATERIALIZED (SELECT rid, vec_id, list_transform(e, lambda x: floor(1024 * x)::BIGINT) AS v FROM e WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS m FROM k WHERE vec_id IS NOT NULL QUALIFY c < 8)",
    ]
    for i in range(ROUNDS):
        ctes.append(f"a{i} AS MATERIALIZED ({nearest.format(f'c{i}')})")
        ctes.append(f"s{i} AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{i} JOIN k USING (rid), range(1, 65) r(i) GROUP BY c, i)")
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(u, m) AS m FROM c{i} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS u FROM s{i} GROUP BY c) USING (c))")
    ctes.append(f"f AS MATERIALIZED ({nearest.format(f'c{ROUNDS}')})")
    return "WITH " + ", ".join(ctes) + f" SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM f JOIN k USING (rid) JOIN c{ROUNDS} USING (c)"


OP12_SQL = _sql()
