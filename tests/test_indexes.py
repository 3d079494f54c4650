"""The stored indexes of vectors and words against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import positions, retrieval, vectors
from quern.sources.shared import folder


def frames(spark, x, kinds, q, q_ids):
    rows = spark.createDataFrame([(i, kinds[i], None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "id long, kind string, embedding array<double>").repartition(5)
    return rows, spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(q_ids, q)], "query_id long, vector array<double>")


def by_hand(x, kinds, q, q_ids, k):
    out = set()
    for qi, v in zip(q_ids, q):
        d = {}
        for i, u in enumerate(x):
            if u is not None and np.any(u):
                d.setdefault(kinds[i], []).append((1.0 - sum_in_order(u, v) / (sum_in_order(u, u) ** 0.5 * sum_in_order(v, v) ** 0.5), i))
        for kind, all_ in d.items():
            out |= {(qi, i, kind) for _, i in sorted(all_)[:k]}
    return out


def sum_in_order(a, b):
    total = 0.0
    for p, r in zip(a, b):
        total += float(p) * float(r)
    return total


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 8))
    x = [centres[i % 12] + rng.normal(0, 0.3, 8) for i in range(400)]
    x += [x[0].copy() for _ in range(150)]  # a hot vector: ties go to the smallest ids
    x += [None, np.zeros(8)]
    kinds = [None if i % 50 == 7 else "abc"[i % 3] for i in range(len(x))]
    q = [x[0], x[5], rng.normal(0, 1, 8), -x[9]]
    return x, kinds, q, [0, 5, 1000, 1001]


@pytest.mark.parametrize("block", [100, 2])
def test_nearest_is_brute_force(spark, some, block):
    rows, queries = frames(spark, *some)
    got = {(r.query_id, r.id, r.kind) for r in vectors.nearest(rows, queries, 5, block=block).collect()}
    assert got == by_hand(*some, 5)
    mine = vectors.nearest(rows, queries, 5, others=True, block=block).where("query_id = id").count()
    assert mine == 0


def test_index_is_exact_by_its_bounds(spark, some):
    rows, queries = frames(spark, *some)
    index = vectors.build(rows, folder(spark, "t"), cells=20)
    got = {(r.query_id, r.id, r.kind) for r in index.search(queries, 5).collect()}
    assert got == by_hand(*some, 5)
    got = {(r.query_id, r.id, r.kind) for r in index.search(queries, 5, block=2).collect()}
    assert got == by_hand(*some, 5)


@pytest.mark.parametrize("limit", [None, 6])
def test_blocks_of_queries_meet_the_index_in_one_exchange(spark, some, monkeypatch, limit):
    """However many blocks there are, two tables are stored (knn_indexed); before, each block was a search of its own, of one table at least."""
    x, kinds, q, q_ids = some
    rng = np.random.default_rng(3)
    q, q_ids = [*q, *rng.normal(0, 1, (30, 8))], [*q_ids, *range(2000, 2030)]
    rows, queries = frames(spark, x, kinds, q, q_ids)
    index, calls = vectors.build(rows, folder(spark, "t"), cells=20), []
    monkeypatch.setattr(vectors, "RANGE", 150)  # several ranges
    monkeypatch.setattr(vectors, "stored", lambda df, path, *parts, old=vectors.stored: calls.append(path) or old(df, path, *parts))
    found = index.search(queries, 5, block=5, limit=limit)
    assert len(calls) == 2
    if limit is None:
        assert {(r.query_id, r.id, r.kind) for r in found.collect()} == by_hand(x, kinds, q, q_ids, 5)
    else:
        got = [tuple(r) for r in retrieval.vector_arm(None, queries, limit, 5, index=index).select("query_id", "id", "rank").collect()]
        kept, want = {}, {}
        for r in found.collect():
            kept.setdefault(r.query_id, []).append((r.dist, r.id))
        for r in vectors.nearest(rows, queries, 5).collect():
            want.setdefault(r.query_id, []).append((r.dist, r.id))
        assert {(i, sorted(v)[n][1], n + 1) for i, v in want.items() for n in range(limit)} == set(got)
        assert all([j for _, j in sorted(kept[i])[:limit]] == [j for _, j in sorted(v)[:limit]] for i, v in want.items())
        assert sum(map(len, kept.values())) < sum(map(len, want.values()))  # the others are left out


def test_index_recall_and_rows_read(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (200, 32))
    x = centres[rng.integers(0, 200, 20_000)] + rng.normal(0, 0.5, (20_000, 32))
    q = x[::200] + rng.normal(0, 0.1, (100, 32))
    rows, queries = frames(spark, list(x), ["k"] * len(x), q, range(100))
    index = vectors.build(rows, folder(spark, "t"))
    probes = 12
    got = {(r.query_id, r.id) for r in index.search(queries, 10, probes=probes).collect()}
    u, v = x / np.linalg.norm(x, axis=1)[:, None], q / np.linalg.norm(q, axis=1)[:, None]
    want = {(i, int(j)) for i, row in enumerate(-(v @ u.T)) for j in np.argsort(row)[:10]}
    assert len(got & want) / len(want) >= 0.9
    assert index.rows_probed(queries, probes) < len(x) / 5
    plan = index._candidates(v, np.eye(100, len(index.centres), dtype=bool), 3)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("ReadSchema")[1] and "PartitionFilters: [" in plan  # codes alone, of the folders probed


def test_indexes_of_nothing(spark):
    none = spark.createDataFrame([], "id long, kind string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert vectors.build(none, folder(spark, "t")).search(queries, 3).count() == 0 and vectors.nearest(none, queries, 3).count() == 0
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0])], "id long, kind string, embedding array<double>")
    assert vectors.build(rows, folder(spark, "t")).search(queries.limit(0), 3).count() == 0
    empty = positions.build(spark.createDataFrame([(1, None), (2, "")], "id long, text string"), folder(spark, "t"))
    assert positions.ranked(empty, positions.all_of(spark.createDataFrame([(1, "a b"), (2, None)], "query_id long, text string"))).count() == 0


def covers_by_hand(words, clauses):
    """The definition: the shortest runs that hold every clause, no run within another; words of the query in each."""
    tokens = {t for c in clauses for alt in c for t in alt}

    def holds(lo, hi):
        return all(any(words[s : s + len(alt)] == alt for alt in c for s in range(lo, hi - len(alt) + 2)) for c in clauses)

    runs = [(lo, hi) for lo in range(len(words)) for hi in range(lo, len(words)) if holds(lo, hi)]
    least = [r for r in runs if not any(s != r and r[0] <= s[0] and s[1] <= r[1] for s in runs)]
    return sum(0.1 / (1 + hi - lo + 1 - sum(w in tokens for w in words[lo : hi + 1])) for lo, hi in least)


def test_cover_density_of_mixed_queries(spark):
    rng = random.Random(3)
    texts = [(i, [rng.choice("abcdxyz") for _ in range(rng.randint(1, 24))]) for i in range(60)]
    index = positions.build(spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "id long, text string"), folder(spark, "t"), buckets=4)
    asked = spark.createDataFrame([(1, "a b"), (2, "c c d")], "query_id long, text string")
    for make, clauses in (
        (positions.any_of, {1: [[["a"], ["b"]]], 2: [[["c"], ["d"]]]}),
        (positions.all_of, {1: [[["a"]], [["b"]]], 2: [[["c"]], [["d"]]]}),
        (positions.phrase, {1: [[["a", "b"]]], 2: [[["c", "c", "d"]]]}),
        (lambda q: positions.both(positions.phrase(q), positions.any_of(q.withColumn("text", F.lit("x y")))), {1: [[["a", "b"]], [["x"], ["y"]]], 2: [[["c", "c", "d"]], [["x"], ["y"]]]}),
    ):
        got = {(r.query_id, r.id): round(r.score, 9) for r in positions.ranked(index, make(asked)).collect()}
        want = {(q, i): round(s, 9) for q, c in clauses.items() for i, w in texts if (s := covers_by_hand(w, c))}
        assert got == want


def test_or_queries_from_rows_and_index_agree_and_exchange_no_other_tokens(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice("abcdxyz") * rng.randint(1, 2) for _ in range(20))) for i in range(50)]
    rows, asked = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(1, "a bb"), (2, "zz"), (3, "")], "query_id long, text string")
    plain = {(r.query_id, r.id): round(r.score, 6) for r in retrieval.lexical_hits(rows, asked).collect()}
    index = positions.build(rows, folder(spark, "t"))
    assert plain == {(r.query_id, r.id): round(r.score, 6) for r in retrieval.lexical_hits(index, asked).collect()}
    n = {i: Counter(t.split()) for i, t in texts}
    assert plain == {(q, i): round(0.1 * s, 6) for q, words in ((1, ["a", "bb"]), (2, ["zz"])) for i in n if (s := sum(n[i][w] for w in words))}
    plan = retrieval.lexical_hits(rows, asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of what the queries met
