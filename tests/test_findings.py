"""What reviews of results and of larger tables found: each test failed before its finding was settled."""

import random
import re
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quern.functions import english
from quern.functions import text as T
from quern.operators import bank, markup, positions, retrieval, similar, vectors
from quern.plans import registry
from quern.sources.shared import folder


def test_equal_lines_follow_the_file(spark, tmp_path):
    """Of lines of one order, date and number the first of the file decides, whatever the order of flags (thread_changes)."""
    at, n = datetime(2000, 1, 1), 40
    spark.range(n).select((F.col("id") * 10 + 2).alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit(at).cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [((i * 10 + 2), 3, flag, at) for flags in ("AN", "NA") for k in (0, 1) for i in range(n) if (i % 2 == 0) == (flags == "AN") for flag in flags[k]]
    df = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp_ntz")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["id"]: r["pinned_at"] for r in registry.queries()["thread_changes"](spark, str(tmp_path)).collect()}
    assert got == {i * 10 + 2: at if i % 2 == 0 else None for i in range(n)}


def test_equal_lines_follow_the_files_in_order(spark, tmp_path):
    """Of equal lines in several files the one in the first file by name decides, wherever it stands in its file (thread_changes)."""
    at, n = datetime(2000, 1, 1), 40
    spark.range(n).select((F.col("id") * 10 + 2).alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit(at).cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    day = pa.timestamp("us")
    for name, ids, flags in (("part-0000", range(n), "AN"), ("part-0001", reversed(range(n)), "NA")):
        lines = [(i * 10 + 2, k, flags[(i + k) % 2], at) for i in ids for k in (2, 3)]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*lines), (pa.int64(), pa.int32(), pa.string(), day))]
        pq.write_table(pa.table(columns, ["l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate"]), f"{tmp_path}/lineitem.parquet/{name}.parquet")
    got = {r["id"]: r["pinned_at"] for r in registry.queries()["thread_changes"](spark, str(tmp_path)).collect()}
    assert got == {i * 10 + 2: at if i % 2 else None for i in range(n)}


WORKS = [
    (1, "#META# a :: b\r\n#META#Header#End#\r\n# one\r\n~~two PageV01P002 three\n### || T\nPageV00P000\n=====\n#META# late\n# four four Four"), (2, "#META# a :: b\n#META# c :: d\nfive\n\nsix PageEndV02P7"),
    (3, "no header\n### | A PageV01P1\n### ||| C\n# x <br> ms12 @QB@ y ____ z"), (4, None), (5, ""), (6, "#META# only :: header"), (7, "### $ entry\nPageV01P001\n" * 50 + "tail"),
]


def test_whole_works_are_parsed_with_one_exchange(spark):
    """parse_whole gives the blocks of parse without a sort or a second copy of the lines (parsed_work, classical_chunks, volume_documents, markup_audit)."""
    works = spark.createDataFrame(WORKS, "work long, text string")
    flat = lambda df: [tuple(r[c] for c in ("work", "heading", "text", "volume", "page")) for r in sorted(df.collect(), key=lambda r: (r.work, r.block))]
    whole = markup.parse_whole(works)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert flat(whole) == flat(markup.parse(markup.lines(works))) and len(flat(whole)) > 50
    assert plan.count("Exchange") == 1 and "Sort" not in plan and "Window" not in plan


def test_audit_carries_no_texts(spark):
    """Runs are counted without their texts; samples are of the first block of the first work."""
    works = spark.createDataFrame(WORKS, "work long, text string")
    blocks = markup.parse_whole(works).orderBy(F.desc("work"), F.desc("block"))
    rows = markup.audit(blocks, show=3, worst=2).collect()
    seen = [(b.work, b.block, b.text, w.lower()) for b in blocks.collect() for w in re.findall(markup.SUSPECT, b.text)]
    count = Counter(s[3] for s in seen)
    best = sorted(count, key=lambda w: (-count[w], w))[:3]
    assert sorted((r.name, r.n, r.work, r.sample) for r in rows if r.part == "artifact") == sorted((w, count[w], *min((s[0], s[1], s[2][:90]) for s in seen if s[3] == w)[::2]) for w in best)
    per = Counter(s[0] for s in seen)
    assert sorted((r.work, r.n) for r in rows if r.part == "work") == sorted(sorted(per.items(), key=lambda x: (-x[1], x[0]))[:2])


def test_stems_are_made_once(spark):
    """A term is stemmed once, not in each comparison, and so are phrasings (unsearchable_terms)."""
    df = bank.unsearchable_terms(spark.createDataFrame([(1, "walking-horses-zebra-that", "He walks; a horse")], "id long, slug string, phrasings string"), ["that"])
    assert df.collect()[0].absent == ["zebra"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("(ies)$") <= 4  # terms and phrasings, in the filter and in the result


def test_quotes_are_counted_within_their_reference(spark):
    """Quotes of all lengths are counted as the pairs of containing are, without exchanging the texts that hold a short one (rebind_by_ref)."""
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "of", "Ward", "forward", "evil", "آية", "x1", "𝒳y", "quite-rare", "words"])
    texts = [(i, f"r{i % 3}", ", ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(200, "r1", None), (201, None, "a"), (202, "r1", "")]
    quotes = [(i, f"r{i % 4}", t[(k := rng.randrange(max(1, len(t)))) : k + rng.randint(1, 40)]) for i, t in enumerate(rng.choice(texts[:60])[2] for _ in range(150))]
    quotes += [(300, "r1", None), (301, "r1", ""), (302, None, "a"), (303, "r1", "nowhere to be found"), (304, "r0", "A")]
    q, d = spark.createDataFrame(quotes, "quote_id long, ref string, quote string"), spark.createDataFrame(texts, "text_id long, ref string, text string")
    want = {}
    for r in similar.containing(q, d, by_ref=True).collect():
        want.setdefault(r.quote_id, []).append(r.text_id)
    got = similar.counted(q, d)
    assert {(r.quote_id, r.n, r.one) for r in got.collect()} == {(k, len(v), min(v)) for k, v in want.items()} and len(want) > 60


def test_quotes_of_any_length_are_counted_without_their_texts(spark, monkeypatch):
    """Texts are read once and meet no quote again, however long it is (rebind_by_ref); runs whose keys agree are compared by code points."""
    plans, put = [], similar.stored
    monkeypatch.setattr(similar, "stored", lambda df, *at: plans.append(df._jdf.queryExecution().executedPlan().toString()) or put(df, *at))
    rng = random.Random(5)
    texts = [(i, f"r{i % 2}", " ".join(rng.choice(["ab", "abc", "b", "cab", "𝒳y"]) for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 5, 9, 40, 200, 200, 9000, 30000])]
    texts += [(i + 50, ref, text) for i, ref, text in texts] + [(99, "r9", "ab")]
    quotes = [(100 * i + n, ref, text[:n]) for i, ref, text in texts[:11] for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65, 300) if n <= len(text)]
    quotes += [(9000 + n, "r1", texts[9][2][-n:]) for n in (1, 4, 16, 50)] + [(9100, "r0", "ab abc zz"), (9101, "none", "ab")]
    got = similar.counted(spark.createDataFrame(quotes, "quote_id long, ref string, quote string"), spark.createDataFrame(texts, "text_id long, ref string, text string"))
    held = {k: [i for i, r, text in texts if r == ref and q in text] for k, ref, q in quotes}
    assert {(r.quote_id, r.n, r.one) for r in got.collect()} == {(k, len(v), min(v)) for k, v in held.items() if v}
    last = got._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in last and "MapInArrow" not in last and sum("MapInArrow" in p for p in plans) == 1

    monkeypatch.setattr(similar, "_keys", lambda h, seeds, n, whole: h & np.uint64(3))
    words = ["abcabca", "", "bca", "abcab" * 9]
    text, sizes = "".join(w + "\n" for w in words), [1, 2, 4, 6]
    begin, full = np.cumsum([0, *(len(w) + 1 for w in words)]), [np.full(128, 255, np.uint8)] * 2
    seen = []
    for n, own, at, edge, same in similar._counts(text, begin, np.arange(4, dtype=np.uint64) % 2, full, sizes):
        seen += [(o, text[i : i + n]) for o, i in zip(own.tolist(), at.tolist())]
        first = np.repeat(edge, np.diff(np.append(edge, len(at))))
        assert same.tolist() == [text[i : i + n] == text[j : j + n] and a % 2 == b % 2 for i, j, a, b in zip(at, at[first], own, own[first])]
    assert sorted(x for x in seen if "\n" not in x[1]) == sorted({(o, w[i : i + n]) for o, w in enumerate(words) for n in sizes for i in range(len(w) - n + 1)})


def test_lexemes_are_counted_without_an_exchange(spark):
    """Texts are read once and their words are not exchanged (english_rank)."""
    texts = [(1, "The walker walks; walking, walked"), (2, None), (3, ""), (4, "no such word"), (1, "walk")]
    rows = spark.createDataFrame(texts, "id long, text string")
    got = english.counted(rows, spark.createDataFrame([("walk",), ("walker",), ("the",), ("none",)], "lexeme string"))
    assert Counter((r.id, r.lexeme, r.n) for r in got.collect()) == Counter([(1, "walk", 3), (1, "walker", 1), (1, "walk", 1)])
    plan = retrieval.english_arm(rows, spark.createDataFrame([(1, "walks")], "query_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and "Generate" not in plan


def test_postings_are_exchanged_once(spark, monkeypatch):
    """Postings are gathered within texts; no place is exchanged alone, and texts are tokenised once (lexical_indexed, hybrid_indexed, cover_density)."""
    plans, put = [], positions.stored
    monkeypatch.setattr(positions, "stored", lambda df, *at: plans.append(df._jdf.queryExecution().executedPlan().toString()) or put(df, *at))
    texts = [(i, " ".join(["a", "b", f"w{i % 7}"] * (i % 5))) for i in range(40)] + [(50, None), (51, " ... "), (1, "a")]
    index = positions.build(spark.createDataFrame(texts, "id long, text string"), folder(spark, "t"))
    assert plans[0].count("Exchange") == 1 and "Aggregate" not in plans[0] and "rangepartitioning" not in plans[0]
    want = Counter((w, i, tuple(p for p, x in enumerate(t.split()) if x == w)) for i, t in texts if t and t != " ... " for w in set(t.split()))
    assert Counter((r.token, r.id, tuple(r.places)) for r in index.postings.collect()) == want
    from_rows = retrieval.lexical_hits(spark.createDataFrame(texts, "id long, text string"), q := spark.createDataFrame([(1, "a w1")], "query_id long, text string"))
    assert {(r.id, round(r.score, 6)) for r in from_rows.collect()} == {(r.id, round(r.score, 6)) for r in retrieval.lexical_hits(index, q).collect()}


def test_covers_open_no_places_of_other_texts(spark):
    """Places meet by text as they are stored, one exchange of whole lists (cover_density)."""
    index = positions.build(spark.createDataFrame([(1, "a b c"), (2, "b a"), (3, "a b"), (4, "c")], "id long, text string"), folder(spark, "t"))
    asked = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    df = positions.ranked(index, positions.both(positions.phrase(asked), positions.any_of(asked.withColumn("text", F.lit("c d")))))
    assert [(r.query_id, r.id, round(r.score, 6)) for r in df.collect()] == [(1, 1, 0.1)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(places" not in plan and "Expand" not in plan.split("Join")[0]


def test_candidates_are_bounded_and_batches_apart(spark):
    """Once k are nearer, later rows are not kept as candidates (knn_per_kind); rows of later batches are no copies of those at their place in earlier ones (knn_top1)."""
    rng = np.random.default_rng(2)
    best, n, k = vectors.Best(2, 3), 1000, 2
    code, ids = best.codes(pa.array(["a", None] * (n // 2))), np.arange(n)
    d = rng.random((n, 3))
    for lo in range(0, n, 10):
        at = slice(lo, lo + 10)
        best.matrix(d[at], d[at], np.arange(3), code[at], ids[at], ids[at])
        best.shrink()
        assert best.n <= 2 * 3 * k
    query, kind, found, _ = best.exact()
    want = {(q, c, int(i)) for q in range(3) for c in (0, 1) for i in sorted(ids[c::2], key=lambda i: d[i, q])[:k]}
    assert set(zip(query.tolist(), kind.tolist(), found.tolist())) == want
    best.matrix(d + 1, d + 1, np.arange(3), code, ids + n, ids + n)
    assert best.n == len(want)  # the limits keep all of them out before they are added
    x = rng.normal(size=(40, 3))
    rows = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "id long, kind string, embedding array<double>").coalesce(1)
    asked = rows.where("id < 4").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {(r.query_id, r.id) for r in vectors.nearest(rows, asked, 1, others=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == {(i, int(np.argsort([2.0 if j == i else -(u[i] @ u[j]) for j in range(40)])[0])) for i in range(4)}


def test_normal_texts_pass_unchanged(spark):
    """Texts are searched for what the normalisation changes before they are rewritten, and Python gets no ASCII (chunk_assembly)."""
    texts = ["plain  text \n", " é\tè ", "é", "ٱلْحَمْدُ ١٢", "a​b", "﴾X﴿", " nb ", "", None, "x "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").select("id", T.normalize_arabic(F.col("t")).alias("n"), T.trimmed(F.col("t")).alias("s"), T.estimate_tokens(F.col("t")).alias("k"))
    got = {r.id: (r.n, r.s, r.k) for r in rows.collect()}
    assert [got[i][0] for i in range(len(texts))] == ["plain text", "é è", "é", "الحمد 12", "ab", "X", "nb", "", "", "x"]
    assert [got[i][1] for i in range(len(texts))] == [t if t is None else t.strip() for t in texts]
    assert [got[i][2] for i in range(len(texts))] == [None if t is None else int(0.35 * (a := sum("؀" <= c <= "ۿ" for c in t)) + 0.25 * (len(t) - a)) + 1 for t in texts]
    assert "octet_length" in rows._jdf.queryExecution().optimizedPlan().toString()
