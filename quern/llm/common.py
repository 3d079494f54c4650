"""What the operators of this package share: the shared folder, staged tables, text chunks, components.

Executors can be lost at any time, so lineage is cut by tables written to the folder that the session
names in ``spark.checkpoint.dir`` (a folder of our own only where that is unset, as in local tests).
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw text bytes of one packed chunk: bounds the memory of every per-chunk task.
CHUNK_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("quern.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.shared.dir", base)
    return base.rstrip("/")


_CACHES: list = []


def remembered(cached):
    """Registers what a Python worker remembers from task to task (an ``lru_cache``)."""
    _CACHES.append(cached)
    return cached


def alone(own=None) -> None:
    """Lets the worker forget, and give back, what operators other than the one of ``own`` have left in it."""
    for cached in _CACHES:
        if cached is not own:
            cached.cache_clear()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # else freed memory stays with the worker
        libc.malloc_trim(0)


class Scratch:
    """Tables of one operator run; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}", set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns a scan of the written table: a cut of the lineage that survives lost executors."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def only(self, *names: str) -> None:
        """Drops all tables but these."""
        if gone := self.names.difference(names):
            self.drop(*gone)


def release_shuffles(spark: SparkSession) -> None:
    """Lets the context cleaner delete the shuffle files of finished jobs now rather than at the next full collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, columns: list[str]) -> str:
    """name, or name with underscores, as none of columns is called."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def spread(spark: SparkSession, nbytes: int, per_part: int = 16 << 20) -> int:
    """Number of buckets or shards for nbytes of data: grows with the data, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nbytes // per_part), 1)


#: Edges that a task of the stars unites, about.
EDGES = 100_000


def components(nodes_edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """Connected components by alternating large and small stars; edges (a long, b long) in any direction.

    Returns (id, component) for each vertex with an edge; component is the smallest id reachable.
    Each round is one aggregate (partial sums before the shuffle, so hubs are no hot key) and one join
    that Spark can split; rounds grow as the logarithm of the number of vertices. Nothing is collected.
    """
    edges = nodes_edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    tasks = max(1, -(-nodes_edges.count() // EDGES))  # few files for few edges
    edges, k = scratch.stage(edges.coalesce(tasks), f"{tag}-0"), 0
    while True:
        # Done when the edges are stars: each vertex has one edge to its root, and no root has any.
        ends = edges.select(F.col("u").alias("x")).unionByName(edges.select(F.col("v").alias("x")).distinct())
        if ends.groupBy("x").count().where("count > 1").isEmpty():
            break
        k += 1
        # Large star: each vertex hands its larger neighbours the smallest vertex around it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # Small star: smaller neighbours and the vertex itself go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch.stage(small.coalesce(tasks), f"{tag}-{k}")
        scratch.drop(f"{tag}-{k - 1}")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return scratch.stage(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.coalesce(tasks)), f"{tag}-out")


class Unions:
    """Union-find over the few vertices of one task; the smallest member is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def u64(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
