"""Nearest vectors: an exact scan by blocks, and a stored index of cells with residual codes.

``nearest`` compares every row with a stated set of queries in cache-sized blocks. Products are summed component by component, as the
column expression does, so equal vectors have equal distances and ties go to the smallest id; a task gives at most ``k`` rows of a kind for each query.

``build`` stores the index: cells are fitted by k-means on a bounded sample, every row goes to its nearest cell and keeps a code of one byte a
component of what the cell leaves, with the length of the error. ``search`` reads the codes of the cells that queries probe: a code bounds a
distance from both sides, so a row goes only if k others of its kind are nearer for sure, and what is left is scored exactly from the vectors. With ``probes`` the
answer comes from so many cells; without, cells whose sphere could still hold a nearer row are read in a second round, and the answer is exact.
More queries than a block holds meet the codes in one exchange, each block of them each range of rows once; their exact answer takes no more jobs, however many they are.

Cases: null and zero vectors mean not embedded and are never near; a query without a vector finds nothing; kinds may be null; repeated ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import vector as V
from quern.sources.shared import folder, reopened, stored

#: Queries that a task holds; beyond, blocks of queries meet blocks of rows. Rows of such a block.
BLOCK, ROWS = 2_000, 20_000
#: Rows of the index whose codes meet a block of queries at once; of them those that give the first limits.
RANGE, FIRST_ROWS = 1 << 17, 2_048
#: Pairs whose sums stay in a core's cache; candidates that a task adds before those that are out go.
PAIRS, ADDED = 1 << 16, 1 << 17
#: Sample of the cells' fit, cells at most (their centres are broadcast), cells of a folder, rounds of the fit.
SAMPLE, MOST_CELLS, FOLDER_CELLS, FIT_ROUNDS = 20_000, 4_096, 8, 8
#: Rows of cell statistics that the driver reads; an index with more is searched without bounds of cells.
MOST_STATS = 500_000


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * x[:, d]
    return np.sqrt(total)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine distances of each row of x from each row of q, summed in order of components."""
    out, step = np.empty((len(x), len(q))), max(1, PAIRS // max(1, len(q)))
    nq, columns = norms(q), np.ascontiguousarray(q.T)
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        total, product = np.zeros((len(part), len(q))), np.empty((len(part), len(q)))
        for d in range(x.shape[1]):
            np.multiply(part[:, d, None], columns[d], out=product)
            total += product
        out[lo : lo + step] = 1.0 - total / (norms(part)[:, None] * nq)
    return out


class Best:
    """Of candidates (query, kind, id, key, low, high): those that may be among the k nearest of their query and kind.

    low and high bound the distance. Of equal vectors (one key) the k smallest ids stay; the others go once k are nearer for sure.
    With limit those go too that so many of their query, at most k of a kind, are nearer than.
    """

    def __init__(self, k: int, queries: int, limit: int | None = None):
        self.queries, self.limit = queries, limit
        self.k, self.kinds, self.parts, self.n, self.most, self.rows = k, {}, [], 0, ADDED, 0
        #: By kind and query: a distance that k of those seen keep within.
        self.limits: dict[int, np.ndarray] = {}
        #: By query: a distance that ``limit`` of those seen keep within, at most k of a kind.
        self.within = np.full(queries, np.inf)

    def codes(self, kinds: pa.Array | pa.ChunkedArray) -> np.ndarray:
        coded = (kinds.combine_chunks() if isinstance(kinds, pa.ChunkedArray) else kinds).dictionary_encode("encode")
        own = np.array([self.kinds.setdefault(v, len(self.kinds)) for v in coded.dictionary.to_pylist()], np.int64)
        return own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.int64)

    def add(self, query: np.ndarray, kind: np.ndarray, ids: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.parts.append((query, kind, ids, key, low, high))
        self.n += len(query)
        if self.n > self.most:
            self.shrink()
            self.most = self.n + ADDED

    def matrix(self, low: np.ndarray, high: np.ndarray, queries: np.ndarray, kind: np.ndarray, ids: np.ndarray, key: np.ndarray) -> None:
        """Adds the rows of (rows x queries) matrices; of each kind only those that its own rows leave."""
        for code in np.unique(kind):
            rows = np.flatnonzero(kind == code)
            l, h = low[rows], high[rows]
            least = np.partition(h, self.k - 1, axis=0)[self.k - 1] if len(rows) > self.k else np.full(h.shape[1], np.inf)
            if code in self.limits:
                least = np.minimum(least, self.limits[code][queries])
            r, q = np.nonzero(l <= np.minimum(least, self.within[queries]))
            self.add(queries[q], np.full(len(r), code), ids[rows[r]], key[rows[r]], l[r, q], h[r, q])

    def first(self, high: np.ndarray, kind: np.ndarray) -> None:
        """Limits of some rows, of which only the upper bounds are given: (queries x rows)."""
        least = []
        for code in np.unique(kind):
            own = high[:, kind == code]
            if own.shape[1] >= self.k:
                own = np.partition(own, self.k - 1, axis=1)[:, : self.k]
                self.limits[code] = own[:, -1]
            least.append(own)
        least = np.concatenate(least, axis=1)
        if self.limit and least.shape[1] >= self.limit:
            self.within = np.partition(least, self.limit - 1, axis=1)[:, self.limit - 1]

    def shrink(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return ()
        query, kind, ids, key, low, high = (np.concatenate(c) for c in zip(*self.parts))

        def place(*order: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
            """Rows in order, and the place of each in its group, the rows that agree in the last ``group`` columns."""
            at = np.lexsort(order)
            new = np.ones(len(at), bool)
            new[1:] = np.any([c[at][1:] != c[at][:-1] for c in order[-group:]], axis=0)
            start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            return at, np.arange(len(at)) - start

        at, rank = place(ids, key, kind, query, group=3)
        at = at[rank < self.k]
        query, kind, ids, key, low, high = (c[at] for c in (query, kind, ids, key, low, high))
        at, rank = place(ids, high, kind, query, group=2)
        group, last = np.cumsum(rank == 0) - 1, rank == self.k - 1
        limit = np.full(int((rank == 0).sum()), np.inf)
        limit[group[last]] = high[at[last]]
        for code in np.unique(kind[at[last]]):
            own = at[last][kind[at[last]] == code]
            known = self.limits.setdefault(code, np.full(self.queries, np.inf))
            known[query[own]] = np.minimum(known[query[own]], high[own])
        if self.limit:
            nearest = at[rank < self.k]
            nearest = nearest[np.lexsort((high[nearest], query[nearest]))]
            begin = np.flatnonzero(np.diff(query[nearest], prepend=-1))
            last = begin[np.diff(begin, append=len(nearest)) >= self.limit] + self.limit - 1
            own = nearest[last]
            self.within[query[own]] = np.minimum(self.within[query[own]], high[own])
        keep = np.empty(len(at), bool)
        keep[at] = low[at] <= np.minimum(limit[group], self.within[query[at]])
        self.parts = [tuple(c[keep] for c in (query, kind, ids, key, low, high))]
        self.n = int(keep.sum())
        return self.parts[0]

    def exact(self) -> tuple[np.ndarray, ...]:
        """The k nearest where low is high: by distance, then id."""
        if not self.shrink():
            return ()
        query, kind, ids, _, low, _ = self.parts[0]
        at = np.lexsort((ids, low, kind, query))
        new = np.ones(len(at), bool)
        new[1:] = (query[at][1:] != query[at][:-1]) | (kind[at][1:] != kind[at][:-1])
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        at = at[rank < self.k]
        return query[at], kind[at], ids[at], low[at]

    def names(self, kind: np.ndarray) -> list:
        known = list(self.kinds)
        return [known[c] for c in kind.tolist()]


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False).astype(np.int64)


def _scan(best: Best, rows: pa.RecordBatch | pa.Table, query_ids: np.ndarray, q: np.ndarray, others: bool) -> None:
    ids, kind = _numbers(rows.column("id")), best.codes(rows.column("kind"))
    column = rows.column("embedding")
    x = matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    # Many times k rows of a kind, where there are as many queries as a block has and ten kinds.
    step = max(best.k + 1, (1 << 21) // max(1, len(q)))
    for lo in range(0, len(ids), step):
        d = distances(x[lo : lo + step], q)
        own = ids[lo : lo + step]
        if others:
            d[own[:, None] == query_ids] = np.inf
        best.matrix(d, d, np.arange(len(q)), kind[lo : lo + step], own, best.rows + np.arange(len(own)))
        best.rows += len(own)  # each row has a key of its own, in later batches too


def _result(best: Best, query_ids: np.ndarray, kind_type: pa.DataType) -> pa.Table:
    query, kind, ids, dist = best.exact() or (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    near = np.isfinite(dist)
    return pa.table({"query_id": pa.array(query_ids[query[near]], pa.int64()), "id": pa.array(ids[near], pa.int64()), "kind": pa.array(best.names(kind[near]), kind_type), "dist": pa.array(dist[near], pa.float64())})


def nearest(rows: DataFrame, queries: DataFrame, k: int, others: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, id, kind, dist): of rows (id, kind, embedding) the k nearest of each kind for each query (query_id, vector); others: never the row of the query's own id."""
    kind_type = rows.schema["kind"].dataType.simpleString()
    schema = f"query_id long, id long, kind {kind_type}, dist double"
    live = rows.where(~V.unembedded(F.col("embedding"))).select(F.col("id").cast("long").alias("id"), "kind", V.doubles(F.col("embedding")).alias("embedding"))
    asked = queries.where(~V.unembedded(F.col("vector"))).select(F.col("query_id").cast("long").alias("query_id"), V.doubles(F.col("vector")).alias("vector"))
    first = asked.limit(block + 1).collect()
    if len(first) <= block:
        # At most ``block`` queries go to each task; the rows are not exchanged.
        if not first:
            return rows.sparkSession.createDataFrame([], schema)
        shared = rows.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in first], np.int64), np.array([r["vector"] for r in first], np.float64)))

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, kind = Best(k, len(shared.value[0])), pa.string()
            for b in batches:
                kind = b.schema.field("kind").type
                _scan(best, b, *shared.value, others)
            yield from _result(best, shared.value[0], kind).to_batches()

        found = live.mapInArrow(scan, schema)
    else:
        blocks, parts = -(-asked.count() // block), -(-live.count() // ROWS)

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            ids = _numbers(right.column("query_id"))
            best = Best(k, len(ids))
            if left.num_rows and right.num_rows:
                _scan(best, left, ids, matrix(right.column("vector").combine_chunks()), others)
            return _result(best, ids, left.schema.field("kind").type)

        a = live.withColumn("part", F.pmod(F.xxhash64("id", "embedding"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        b = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        found = a.groupBy("part", "block").cogroup(b.groupBy("part", "block")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("dist", "id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def fit_cells(sample: np.ndarray, cells: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centres of cells by k-means over unit vectors; an empty cell keeps its centre."""
    centres = sample[np.random.default_rng(17).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        label = (sample @ centres.T - (centres * centres).sum(1) / 2).argmax(1)
        n = np.bincount(label, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, label, sample)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def build(rows: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Stores the index of rows (id, kind, embedding) under path."""
    spark = rows.sparkSession
    live = rows.where(~V.unembedded(F.col("embedding"))).select(F.col("id").cast("long").alias("id"), "kind", V.doubles(F.col("embedding")).alias("embedding"))
    n = live.count()
    cells = cells or max(1, min(MOST_CELLS, round(n**0.5)))
    some = live.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()
    x = np.array([r["embedding"] for r in some], np.float64)
    centres = fit_cells(x / norms(x)[:, None], cells) if n else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(centres)  # at most MOST_CELLS rows
    kind = rows.schema["kind"].dataType.simpleString()

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("embedding"))
            unit = x / norms(x)[:, None]
            cell = (unit @ shared.value.T - (shared.value**2).sum(1) / 2).argmax(1)
            left = unit - shared.value[cell]
            scale = np.maximum(np.abs(left).max(1), 1e-12) / 127
            code = np.round(left / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(left - code * scale[:, None], axis=1)
            columns = {
                "cell": pa.array(cell, pa.int32()), "id": b.column("id"), "kind": b.column("kind"), "code": pa.array([c.tobytes() for c in code], pa.binary()), "scale": pa.array(scale), "error": pa.array(error * (1 + 1e-9) + 1e-12),
                "far": pa.array(np.linalg.norm(left, axis=1)), "key": pa.array([xxhash.xxh3_64_intdigest(v.tobytes()) - (1 << 63) for v in x], pa.int64()), "embedding": b.column("embedding"),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    placed = live.mapInArrow(place, f"cell int, id long, kind {kind}, code binary, scale double, error double, far double, key long, embedding array<double>")
    placed = placed.withColumn("folder", F.floor(F.col("cell") / FOLDER_CELLS).cast("int"))
    # Hot cells are spread over tasks: ranges of (cell, id).
    table = stored(placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), f"{path}/rows", "folder")
    stored(table.groupBy("cell", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")), f"{path}/stats")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/cells")
    return VectorIndex(spark, path)


class VectorIndex:
    """A stored index: rows by cell, statistics of cells, centres."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows, self.stats = reopened(spark, f"{path}/rows"), reopened(spark, f"{path}/stats")
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MOST_CELLS
        self.spark, self.centres = spark, np.array([r["centre"] for r in cells], np.float64)

    def _met(self, asked: DataFrame, blocks: int, k: int, limit: int | None) -> DataFrame:
        """As ``_candidates``, of queries (q, vector, block): each block meets each range of rows once, all cells that it reaches."""
        kind_type = self.rows.schema["kind"].dataType.simpleString()
        shared, ranges = self.spark.sparkContext.broadcast(self.centres), max(1, -(-self.rows.count() // RANGE))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            number, best, kinds = _numbers(right.column("q")), Best(k, right.num_rows, limit), left.schema.field("kind").type
            if left.num_rows and right.num_rows:
                q = matrix(right.column("vector").combine_chunks())
                _scan_codes(best, left, q / norms(q)[:, None], shared.value)
            query, kind, ids, key, low, high = best.shrink() or (np.zeros(0, np.int64),) * 4 + (np.zeros(0),) * 2
            return pa.table({"q": pa.array(number[query], pa.int64()), "id": pa.array(ids, pa.int64()), "kind": pa.array(best.names(kind), kinds), "key": pa.array(key, pa.int64()), "low": pa.array(low, pa.float64()), "high": pa.array(high, pa.float64())})

        a = self.rows.select("id", "kind", "cell", "code", "scale", "error", "far", "key", F.pmod(F.xxhash64("id", "key"), F.lit(ranges)).cast("int").alias("part")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        b = asked.select("q", "vector", "block", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("part"))
        return a.groupBy("part", "block").cogroup(b.groupBy("part", "block")).applyInArrow(meet, f"q long, id long, kind {kind_type}, key long, low double, high double")

    def _candidates(self, q: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
        """(q, id, kind, key, low, high) of the cells that wanted (queries x cells) names: those that may be among the k nearest."""
        cells = np.flatnonzero(wanted.any(0)).tolist()
        folders = sorted({c // FOLDER_CELLS for c in cells})
        shared = self.spark.sparkContext.broadcast((q, self.centres, {c: np.flatnonzero(wanted[:, c]) for c in cells}))
        rows = self.rows.where(F.col("folder").isin(folders) & F.col("cell").isin(cells)).select("id", "kind", "cell", "code", "scale", "error", "key")
        kind_type = self.rows.schema["kind"].dataType.simpleString()

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, centres, who = shared.value
            best, kinds = Best(k, len(q)), None
            for b in batches:
                kinds = b.schema.field("kind").type
                if not b.num_rows:
                    continue
                cell, ids, key = (_numbers(b.column(c)) for c in ("cell", "id", "key"))
                kind, held = best.codes(b.column("kind")), b.column("code").cast(pa.large_binary())
                at = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
                code = np.frombuffer(held.buffers()[2], np.int8)[at[0] : at[-1]].reshape(len(ids), -1)
                scale, error = (b.column(c).to_numpy() for c in ("scale", "error"))
                for c in np.unique(cell):
                    own, asked = np.flatnonzero(cell == c), who[int(c)]
                    step = max(k + 1, (1 << 19) // len(asked))
                    for lo in range(0, len(own), step):
                        at = own[lo : lo + step]
                        about = 1 - (centres[c] + code[at] * scale[at, None]) @ q[asked].T
                        best.matrix(about - error[at, None], about + error[at, None], asked, kind[at], ids[at], key[at])
            if found := best.shrink():
                query, kind, ids, key, low, high = found
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(ids, pa.int64()), pa.array(best.names(kind), kinds), pa.array(key, pa.int64()), pa.array(low), pa.array(high)], ["q", "id", "kind", "key", "low", "high"])

        return rows.mapInArrow(scan, f"q int, id long, kind {kind_type}, key long, low double, high double")

    def rows_probed(self, queries: DataFrame, probes: int) -> int:
        """Rows whose codes a search with so many probes reads for a query, at most."""
        q = _unit(queries.collect())[1]
        n = {r["cell"]: r["n"] for r in self.stats.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
        return max((sum(n.get(int(c), 0) for c in row) for row in self._order(q)[:, :probes]), default=0)

    def _order(self, q: np.ndarray) -> np.ndarray:
        """Cells of each query, nearest first."""
        return np.argsort((self.centres * self.centres).sum(1) - 2 * q @ self.centres.T, axis=1, kind="stable")

    def _reach(self, q: np.ndarray, limits: dict) -> np.ndarray:
        """Whether a cell may hold a row within the limit of its kind, for queries x cells; kinds without a limit reach everywhere."""
        chord = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (self.centres * self.centres).sum(1) - 2 * q @ self.centres.T, 0))
        wanted = np.zeros(chord.shape, bool)
        by_kind: dict = {}
        for r in self.stats.collect():
            by_kind.setdefault(r["kind"], []).append((r["cell"], r["far"]))
        for kind, cells in by_kind.items():
            at, far = np.array([c for c, _ in cells]), np.array([f for _, f in cells])
            limit = np.array([limits.get((i, kind), np.inf) for i in range(len(q))])
            wanted[:, at] |= np.maximum(chord[:, at] - far - 1e-9, 0) ** 2 / 2 <= limit[:, None] + 1e-9
        return wanted

    def search(self, queries: DataFrame, k: int, probes: int | None = None, block: int = BLOCK, first: int = 4, limit: int | None = None) -> DataFrame:
        """(query_id, id, kind, dist): the k nearest rows of each kind for queries (query_id, vector).

        With probes those of so many cells, nearest first; without, the exact answer. Queries go in blocks. With limit, rows that are not
        among so many nearest of a query, at most k of a kind, may be left out.
        """
        n = -(-queries.count() // block)
        if n > 1 and probes is None:
            path, live = folder(self.spark, "candidates"), queries.where(~V.unembedded(F.col("vector")))
            asked = live.select(F.col("query_id").cast("long").alias("query_id"), V.doubles(F.col("vector")).alias("vector")).withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), F.lit(n)).cast("int")).withColumn("q", F.monotonically_increasing_id())
            asked = stored(asked, f"{path}/asked")
            found = stored(self._met(asked, n, k, limit), f"{path}/met")
            return _scored(self.rows, found, asked, k, limit)
        if n > 1:
            own = F.pmod(F.xxhash64("query_id", "vector"), F.lit(n))
            return reduce(DataFrame.unionByName, [self.search(queries.where(own == i), k, probes, 2 * block, first) for i in range(n)])
        ids, q = _unit(queries.where(~V.unembedded(F.col("vector"))).collect())
        kind_type = self.rows.schema["kind"].dataType.simpleString()
        if not len(q) or not len(self.centres):
            return self.spark.createDataFrame([], f"query_id long, id long, kind {kind_type}, dist double")
        wanted = np.zeros((len(q), len(self.centres)), bool)
        np.put_along_axis(wanted, self._order(q)[:, : probes or first], True, 1)
        path = folder(self.spark, "candidates")
        found = stored(self._candidates(q, wanted, k), f"{path}/near")
        if probes is None:
            if self.stats.limit(MOST_STATS + 1).count() > MOST_STATS:
                more = np.ones_like(wanted)
            else:
                # At most a row for each query and kind.
                limits = {(r["q"], r["kind"]): r["most"] for r in _limited(found, k).where("most is not null").select("q", "kind", "most").distinct().collect()}
                more = self._reach(q, limits)
            if (more & ~wanted).any():
                found = stored(found.unionByName(self._candidates(q, more & ~wanted, k)), f"{path}/all")
                wanted |= more
        asked = self.spark.createDataFrame([(i, int(v), x.tolist()) for i, (v, x) in enumerate(zip(ids, q))], "q int, query_id long, vector array<double>")
        cells = np.flatnonzero(wanted.any(0)).tolist()
        rows = self.rows.where(F.col("folder").isin(sorted({c // FOLDER_CELLS for c in cells})) & F.col("cell").isin(cells))
        return _scored(rows, found, F.broadcast(asked), k)  # a block of queries


def _scan_codes(best: Best, rows: pa.Table, q: np.ndarray, centres: np.ndarray) -> None:
    """Adds the rows (id, kind, cell, code, scale, error, far, key) that may be near unit vectors q, cell by cell; a cell meets the queries whose limits reach it."""
    cell, ids, key = (_numbers(rows.column(c)) for c in ("cell", "id", "key"))
    scale, error, far = (rows.column(c).to_numpy() for c in ("scale", "error", "far"))
    kind, d = best.codes(rows.column("kind")), q.shape[1]
    code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(len(ids), d)
    error = error + (d + 16) * 2.0**-23  # products are summed in single precision
    columns = np.ascontiguousarray(q.T, np.float32)

    def about(at: np.ndarray, asked: np.ndarray | slice) -> np.ndarray:
        return 1 - (centres[cell[at]] + code[at] * scale[at, None]).astype(np.float32) @ columns[:, asked]

    some = np.unique(np.linspace(0, len(ids) - 1, FIRST_ROWS).astype(np.int64))
    best.first(np.ascontiguousarray((about(some, slice(None)) + error[some, None]).T), kind[some])
    order = np.argsort(cell, kind="stable")
    cells, begin = np.unique(cell[order], return_index=True)
    groups, held, known = np.split(order, begin[1:]), None, -1
    chord = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (centres[cells] ** 2).sum(1) - 2 * q @ centres[cells].T, 0))
    for c in np.argsort(chord.mean(0)).tolist():
        if held is not best.parts or known != best.most:
            # After candidates went: a row of limits for each kind that has one, and one for the others.
            held, known = best.parts, best.most
            place = np.full(len(best.kinds), len(best.limits))
            place[list(best.limits)] = np.arange(len(best.limits))
            table = np.minimum(np.array([*best.limits.values(), np.full(len(q), np.inf)]), best.within)
            least = table.astype(np.float32)
        own = groups[c]
        widest = table[np.unique(place[kind[own]])].max(0)
        reached = np.flatnonzero(np.maximum(chord[:, c] - far[own].max() - 1e-9, 0) ** 2 / 2 <= widest + 1e-9)
        if not len(reached):
            continue
        limits = least if len(reached) == len(q) else least[:, reached]
        step = max(1, (1 << 19) // len(reached))
        for lo in range(0, len(own), step):
            at = own[lo : lo + step]
            low = about(at, reached)
            low -= error[at, None].astype(np.float32)
            r, near = np.nonzero(low <= limits[place[kind[at]]])
            l = low[r, near].astype(np.float64)
            best.add(reached[near], kind[at[r]], ids[at[r]], key[at[r]], l, l + 2 * error[at[r]])


def _scored(rows: DataFrame, found: DataFrame, asked: DataFrame, k: int, limit: int | None = None) -> DataFrame:
    """(query_id, id, kind, dist): the k nearest rows of each kind, of the candidates found of queries (q, query_id, vector)."""
    left = _limited(found, k, limit).where("most is null or low <= most").select("q", "id", "key").distinct()
    scored = rows.select("id", "key", "kind", "embedding").join(left, ["id", "key"]).join(asked, "q")
    scored = scored.select("query_id", "id", "kind", V.cosine_distance(F.col("embedding"), F.col("vector")).alias("dist"))
    rank = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("dist", "id"))
    return scored.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    q = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)
    return np.array([r["query_id"] for r in rows], np.int64), q / norms(q)[:, None]


def _limited(found: DataFrame, k: int, limit: int | None = None) -> DataFrame:
    """found with column most: the k-th smallest upper bound of its query and kind, or with limit that of so many of its query if it is smaller; null where there are fewer."""
    group = Window.partitionBy("q", "kind")
    rank = F.row_number().over(group.orderBy("high", "id"))
    out = found.withColumn("_r", rank).withColumn("most", F.max(F.when(F.col("_r") == k, F.col("high"))).over(group))
    if limit:
        place = F.count_if(F.col("_r") <= k).over(Window.partitionBy("q").orderBy("high", "id").rowsBetween(Window.unboundedPreceding, 0))
        within = F.min(F.when(F.col("_p") >= limit, F.col("high"))).over(Window.partitionBy("q"))
        out = out.withColumn("_p", place).withColumn("most", F.least("most", within)).drop("_p")
    return out.drop("_r")
