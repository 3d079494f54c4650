"""Operator 4: near-duplicate vectors by a forest of random-projection trees.

Each tree halves the space again and again by a random direction at the median of a bounded sample
(``SAMPLE`` vectors; every vector is then indexed); a vector within ``spill`` of a threshold goes to both
sides. In each leaf all vectors are compared exactly, in blocks. A pair that meets in several leaves is
counted in the first of them alone, which its two lists of leaves tell, so no list of pairs is ever
written: a leaf gives sums per vector and a spanning forest of its links. Leaves of any size are
processed: beyond ``BLOCK`` vectors they are cut into blocks and all pairs of blocks are compared.

Equal vectors are one item from the start. Nodes are split until their leaves are small, and trees are added until the pairs that the forest is tried on meet; recall against brute force is tested.

Cases: null, zero, null or non-finite components: linked with nothing (n_links 0, a component of its own, kept); vectors of
different lengths never link; repeated vec_ids are separate vectors with the same id; a null vec_id is left out of links and comes
back with null component; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, components, release_shuffles

LEAF, BLOCK, SAMPLE = 512, 1024, 20_000
#: Trees at least and at most; the share of made pairs at the threshold that must meet, and how many are made.
TREES, MOST_TREES, RECALL, PAIRS = 4, 64, 0.95, 2_000
#: Sampled vectors that a node needs for a threshold of its own; what a split leaves of a node, about; how the spill shrinks from level to level.
LEAST, SHRINK, SPILL_DECAY, MOST_LEVELS = 32, 0.58, 0.8, 54
THRESHOLD = 0.95


class Forest:
    """Directions and thresholds; the path of a node has a leading 1 and a bit for each level.

    A node is split as long as the vectors that reach it, spill included, are more than ``leaf`` by what the sample says. Below the nodes that the sample
    can tell (``LEAST`` sampled vectors) a node counts for SHRINK of the one above, and thresholds are those of the level. The spill shrinks with
    the level, so a vector's copies in a tree are bounded, whatever the depth. As deeper trees part more pairs, trees are added until ``RECALL`` of made pairs meet:
    sampled vectors with partners exactly at the threshold, in random directions, which are the hardest pairs that count.
    """

    def __init__(self, sample: np.ndarray, n: int, threshold: float, trees: int = TREES, leaf: int = LEAF):
        d = sample.shape[1]
        rng = np.random.default_rng(41)
        each = n / max(1, len(sample))  # vectors that one of the sample stands for
        self.spill = [0.75 * math.sqrt(2 * (1 - threshold)) / math.sqrt(d) * SPILL_DECAY**level for level in range(MOST_LEVELS)]
        self.directions: list[list[np.ndarray]] = []
        self.cuts: list[list[dict[int, float]]] = []  # of a level: thresholds of the nodes that are split
        self.rest: list[list[float]] = []  # of a level: threshold of nodes that the sample can't tell
        self.deeper: list[dict[int, int]] = []  # such nodes with the levels that are still to come
        base = sample[np.linspace(0, len(sample) - 1, min(PAIRS, len(sample))).astype(np.int64)] if len(sample) else sample
        partners = self.partners(base, threshold, np.random.default_rng(43))
        met = np.zeros(len(base), bool)
        while len(self.cuts) < trees or (len(base) and met.mean() < RECALL and len(self.cuts) < max(trees, MOST_TREES)):
            directions, cuts, rest, deeper = [], [], [], {}
            row, path = np.arange(len(sample)), np.ones(len(sample), np.int64)
            while len(row) and len(directions) < MOST_LEVELS:
                own, order = {}, np.argsort(path, kind="stable")
                x = rng.standard_normal(d)
                x /= max(float(np.linalg.norm(x)), 1e-300)
                p = (sample @ x)[row]
                for part in np.split(order, np.flatnonzero(np.diff(path[order])) + 1):
                    if len(part) * each > leaf and np.ptp(p[part]) > 0:
                        if len(part) >= LEAST:
                            own[int(path[part[0]])] = float(np.median(p[part]))
                        else:
                            deeper[int(path[part[0]])] = math.ceil(math.log(len(part) * each / leaf) / -math.log(SHRINK))
                if not own:
                    break
                spill = self.spill[len(directions)]
                directions.append(x)
                cuts.append(own)
                rest.append(float(np.median(p)))
                live = np.array([int(v) in own for v in path])
                row, path, p = row[live], path[live], p[live]
                cut = np.array([own[int(v)] for v in path])
                left, right = p < cut + spill, p >= cut - spill
                row, path = np.concatenate((row[left], row[right])), np.concatenate((2 * path[left], 2 * path[right] + 1))
            for k in range(max(deeper.values(), default=0) + 1 if deeper else 0):  # directions below the sample's reach
                if len(directions) < MOST_LEVELS:
                    x = rng.standard_normal(d)
                    x /= max(float(np.linalg.norm(x)), 1e-300)
                    directions.append(x)
                    cuts.append({})
                    rest.append(float(np.median(sample @ x)))
            self.directions.append(directions)
            self.cuts.append(cuts)
            self.rest.append(rest)
            self.deeper.append(deeper)
            if len(base) and d > 1:
                row, code = self.leaves(np.concatenate((base, partners)), len(self.cuts) - 1)
                half = row < len(base)
                own = set(zip(row[half].tolist(), code[half].tolist()))
                met[[r - len(base) for r, c in zip(row[~half].tolist(), code[~half].tolist()) if (r - len(base), c) in own]] = True
            else:
                met[:] = True

    @staticmethod
    def partners(x: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
        """For each unit vector one at the threshold's cosine."""
        z = rng.standard_normal(x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        return threshold * x + math.sqrt(1 - threshold**2) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)

    @property
    def depth(self) -> int:
        return max(map(len, self.cuts), default=0)

    def leaves(self, x: np.ndarray, tree: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf code) of unit vectors, by row and ascending code; of one tree or of all."""
        rows, codes = [], []
        for t in range(len(self.cuts)) if tree is None else (tree,):
            row, path, left_over = np.arange(len(x)), np.ones(len(x), np.int64), np.zeros(len(x), np.int64)
            for level, direction in enumerate(self.directions[t]):
                known, place = np.unique(path, return_inverse=True)
                cut = np.array([self.cuts[t][level].get(int(k), np.nan) for k in known])[place]
                more = np.array([self.deeper[t].get(int(k), 0) for k in known])[place]
                left_over = np.maximum(left_over, more)
                cut = np.where(np.isnan(cut) & (left_over > 0), self.rest[t][level], cut)
                split = ~np.isnan(cut)
                rows.append(row[~split])
                codes.append(path[~split] + (t << 56))
                row, path, cut, left_over = row[split], path[split], cut[split], np.maximum(left_over[split] - 1, 0)
                p = (x @ direction)[row]
                left, right = p < cut + self.spill[level], p >= cut - self.spill[level]
                row, path, left_over = np.concatenate((row[left], row[right])), np.concatenate((2 * path[left], 2 * path[right] + 1)), np.concatenate((left_over[left], left_over[right]))
            rows.append(row)
            codes.append(path + (t << 56))
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        return row[order], code[order]


def _spanning(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    fresh, edges = np.ones(len(adjacent), bool), []
    for root in range(len(adjacent)):
        if not fresh[root]:
            continue
        fresh[root], todo = False, [root]
        while todo:
            v = todo.pop()
            new = np.flatnonzero(adjacent[v] & fresh)
            fresh[new] = False
            edges += [(v, int(w)) for w in new]
            todo += new.tolist()
    return edges


def _leaf(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("id").to_pylist(), np.int64)
        order = np.argsort(ids, kind="stable")
        table, ids = table.take(pa.array(order)), ids[order]
        weight = np.array(table.column("n").to_pylist(), np.int64)
        x = np.stack([np.frombuffer(v, "<f8") for v in table.column("v").to_pylist()])
        here = table.column("leaf")[0].as_py()
        before = [np.frombuffer(c, "<i8") for c in table.column("codes").to_pylist()]
        before = [c[c < here] for c in before]
        known, place = np.unique(np.concatenate(before), return_inverse=True)
        met = np.zeros((len(ids), max(1, len(known))), np.float32)
        met[np.repeat(np.arange(len(ids)), [len(c) for c in before]), place] = 1
        block = np.array(table.column("block").to_pylist())
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if i != j:
            near &= block[:, None] != block[None, :]
        counted = near & (met @ met.T == 0)
        total = counted @ weight
        edges = _spanning(near)
        a = [*ids[total > 0].tolist(), *(int(ids[v]) for v, _ in edges)]
        b = [*([None] * int((total > 0).sum())), *(int(ids[w]) for _, w in edges)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([*total[total > 0].tolist(), *([0] * len(edges))], pa.int64())})

    return run


def near(vectors: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "forest")

    def units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, unit, length = [], [], [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
                x = None if v is None or None in v else np.array(v, np.float64)
                if x is not None and len(x) and np.isfinite(x).all() and x.any():
                    scale = np.abs(x).max()  # first, so that squares neither overflow nor vanish
                    u = x / scale
                    u = u / np.linalg.norm(u) + 0.0
                    keys.append(xxhash.xxh3_128_digest((x + 0.0).astype("<f8").tobytes()))
                    unit.append(u.astype("<f8").tobytes())
                    length.append(len(u))
                else:
                    keys.append(None)
                    unit.append(None)
                    length.append(0)
                ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(unit, pa.binary()), pa.array(length, pa.int32())], ["vec_id", "key", "v", "d"])

    rows = scratch.stage(vectors.select("vec_id", "embedding").mapInArrow(units, "vec_id long, key binary, v binary, d int"), "units")
    # An item is a distinct vector, with a number of its own: one vec_id may stand for several.
    items = rows.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"), F.first("d").alias("d"))
    items = scratch.stage(items.withColumn("id", F.monotonically_increasing_id()), "items")
    totals, edges = None, None
    for d, n in sorted((r["d"], r["count"]) for r in items.groupBy("d").count().collect()):  # one forest for each length of vectors
        same = items.where(F.col("d") == d)
        sample = same.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").collect() if n > LEAF else []
        forest = Forest(np.stack([np.frombuffer(r["v"], "<f8") for r in sample]) if sample else np.zeros((0, d)), n, threshold)

        def assigned(batches: Iterable[pa.RecordBatch], forest=forest) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 512):
                    part = b.slice(lo, 512)
                    v = part.column("v").to_pylist()
                    row, code = forest.leaves(np.stack([np.frombuffer(x, "<f8") for x in v]))
                    start = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(v)))))
                    codes = [code[s:e].astype("<i8").tobytes() for s, e in zip(start, start[1:])]
                    own = {c: part.column(c).take(pa.array(row)) for c in ("id", "n")}
                    yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), own["id"], own["n"], pa.array([v[r] for r in row], pa.binary()), pa.array([codes[r] for r in row], pa.binary())], ["leaf", "id", "n", "v", "codes"])

        placed = scratch.stage(same.select("id", "n", "v").repartition(spark.sparkContext.defaultParallelism, "id").mapInArrow(assigned, "leaf long, id long, n long, v binary, codes binary"), f"placed-{d}")
        large = placed.groupBy("leaf").count().where(F.col("count") > BLOCK).select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        cut = placed.join(large, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cut = cut.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
        found = scratch.stage(cut.groupBy("leaf", "i", "j").applyInArrow(_leaf(threshold), "a long, b long, n long"), f"found-{d}")
        scratch.drop(f"placed-{d}")
        release_shuffles(spark)
        one, two = found.where("b is null").select(F.col("a").alias("id"), "n"), found.where("b is not null").select("a", "b")
        totals, edges = (one, two) if totals is None else (totals.unionByName(one), edges.unionByName(two))
    if totals is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    comps = components(edges, scratch)
    sums = totals.groupBy("id").agg(F.sum("n").alias("links"))
    facts = items.select("key", "id", "n", "least").join(sums, "id", "left").join(comps, "id", "left").withColumn("c", F.coalesce("component", "id"))
    named = facts.groupBy("c").agg(F.min("least").alias("component_id"))
    facts = facts.join(named, "c").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    own = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key"))
    out = own.join(facts, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return scratch.stage(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "out")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT v, min(root) AS root FROM (WITH RECURSIVE w AS (SELECT vec_id AS v, vec_id AS root FROM v UNION SELECT p.b, w.root FROM w JOIN p ON w.v = p.a) SELECT * FROM w) GROUP BY v)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.root, m.vec_id) AS component_id, coalesce(c.root, m.vec_id) = m.vec_id AS kept
FROM embeddings m LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) n ON n.a = m.vec_id LEFT JOIN c ON c.v = m.vec_id
"""
