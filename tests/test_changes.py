"""Appends that replay, batches that are halved, sections, sets that change, audits, best hits by tokens."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import answers, backends, bank, prose, retrieval, tables, worksheets
from quern.sources import readers
from quern.streaming import appends


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "log"), lambda *ids: spark.createDataFrame([(i, f"q{i}") for i in ids], "id long, q string")
    assert appends.append_once(rows(1, 2), path, "a", 0) and appends.append_once(rows(3), path, "a", 1) and appends.append_once(rows(1), path, "b", 0)
    before = sorted(p.name for p in (tmp_path / "log").rglob("*.parquet"))
    assert not appends.append_once(rows(1, 2, 9), path, "a", 0)
    assert sorted(p.name for p in (tmp_path / "log").rglob("*.parquet")) == before
    assert sorted((r.id, r.stream, r.batch) for r in appends.stored_rows(spark, path).collect()) == [(1, "a", 0), (1, "b", 0), (2, "a", 0), (3, "a", 1)]
    # A batch that failed half-way has no mark: it is written again, whole.
    (tmp_path / "log/batches/stream=a/batch=1/_SUCCESS").unlink()
    assert appends.append_once(rows(3, 4), path, "a", 1)
    assert sorted(r.id for r in appends.stored_rows(spark, path).where("stream = 'a'").collect()) == [1, 2, 3, 4]
    assert appends.append_once(rows(), str(tmp_path / "none"), "a", 0) and appends.stored_rows(spark, str(tmp_path / "none")).count() == 0


def test_a_stream_is_stored_once(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "log")
    for k in range(3):
        spark.createDataFrame([(k * 10 + i,) for i in range(5)], "id long").coalesce(1).write.mode("append").parquet(str(source))

    def run(checkpoint):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(source))
        stream.writeStream.foreachBatch(appends.sink(path, "s")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    run("c1")
    run("c2")  # a lost checkpoint: all batches come again
    assert sorted(r.id for r in appends.stored_rows(spark, path).collect()) == sorted(k * 10 + i for k in range(3) for i in range(5))


def test_batches_are_halved(spark):
    def tight():
        calls = []

        def model(pairs):
            calls.append(len(pairs))
            if len(pairs) > 3:
                raise RuntimeError("CUDA out of memory")
            return [float(len(a) + len(b)) for a, b in pairs]

        return model

    rows = [(i, "x" * (i % 5), "y" * (i % 7)) for i in range(40)] + [(99, None, "y")]
    df = spark.createDataFrame(rows, "id long, q string, t string").select("id", backends.reranker(tight, 32)("q", "t").alias("s"))
    assert {r.id: r.s for r in df.collect()} == {i: None if q is None else float(len(q) + len(t)) for i, q, t in rows}
    seen = []

    def model(batch):
        seen.append(len(batch))
        if len(batch) > 3:
            raise MemoryError
        return list(batch)

    assert backends.halving(model, list(range(20)), 16) == list(range(20)) and seen[:3] == [16, 8, 4] and max(seen[3:]) == 2
    with pytest.raises(MemoryError):
        backends.halving(lambda b: (_ for _ in ()).throw(MemoryError()), [1, 2], 2)
    with pytest.raises(ZeroDivisionError):
        backends.halving(lambda b: 1 / 0, [1, 2], 2)
    with pytest.raises(ValueError):
        backends.halving(lambda b: [], [1, 2], 2)


def test_sections(spark):
    text = "- slug: early\n# 1. First  \n- slug: a\n# a comment\n-   slug:   b  \n#2. Second: more\nslug: no\n- slug: a\n- slug: two words"
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "file string, line int, raw string")
    assert sorted((r.slug, r.number, r.title) for r in answers.sections(lines).collect()) == [("a", 2, "Second: more"), ("b", 1, "First")]


def test_verdicts_and_flags(spark):
    rows = [("quran", "fiqh", "r", "s"), ("tafsir", "quran", "r", "s"), ("fiqh", "tafsir", "r", "r"), ("fiqh", "hadith", "r", "s"), ("fiqh", "fiqh", "r", "r")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    assert [r.v for r in df.select(answers.verdict(*map(F.col, "abcd")).alias("v")).collect()] == ["MOVED", "shifted", "REGRESSED", "shifted", "same"]
    rows = [("A", "x", "quran", "q", 0.1), ("C", "x", "quran", "q", 0.1), ("A", "creed", "quran", "q", 0.1), ("A", None, "tafsir", "law", 0.1), ("A", None, "tafsir", "t", 0.1), ("A", None, "quran", "q", 0.15), ("A", None, "fiqh", "f", 0.0)]
    df = spark.createDataFrame(rows, "tier string, section string, kind string, source string, score double")
    flag = answers.tier_flag(*map(F.col, ("tier", "section", "kind", "source", "score")), ("law",), ("creed",))
    assert [r.f for r in df.select(flag.alias("f")).collect()] == ["CHECK", "ok", "ok", "ok", "CHECK", "ok", "ok"]


def test_changed_sets(spark):
    old, new = (spark.createDataFrame(rows, "k int, m string") for rows in ([(1, "a"), (1, "b"), (1, "b"), (2, "x"), (3, "y")], [(1, "b"), (1, "c"), (2, "x"), (4, "z")]))
    assert sorted((r.k, r.added, r.removed) for r in tables.changed_sets(old, new, "k", "m").collect()) == [(1, ["c"], ["a"]), (3, [], ["y"]), (4, ["z"], [])]


def test_candidate_addresses(spark):
    uris = spark.createDataFrame([("0310Tab.Book.V1-x1",), ("0010A.B.V",), ("no version",), (None,)], "uri string")
    got = {}
    for r in readers.candidate_addresses(uris, "b").orderBy("uri", "rank").collect():
        got.setdefault(r.uri, []).append(r.address)
    assert [len(v) for v in got.values()] == [10, 15]
    first = got["0310Tab.Book.V1-x1"]
    assert first[0] == "b/0325AH/master/data/0310Tab/0310Tab.Book/0310Tab.Book.V1-x1.mARkdownSimple" and first[4].endswith("V1-x1") and first[5].startswith("b/0350AH") and first[10].startswith("b/0300AH")


def test_translation_findings(spark):
    chunks = spark.createDataFrame([(1, "hadith", "He said: the run, here."), (2, "quran", "verse words")], "chunk_id long, kind string, text string")
    rows = [(1, 1, "THE RUN", 0.9, "x"), (2, 1, "", 0.9, "x"), (3, 1, "other", 1.5, " "), (4, 2, "verse", 0.9, "x"), (5, 7, "verse", None, None), (6, 1, None, 1.0, "x")]
    df = spark.createDataFrame(rows, "id long, chunk_id long, matched string, coverage double, english string")
    got = {}
    for r in bank.translation_findings(df, chunks).collect():
        got.setdefault(r.id, set()).add(r.finding)
    assert got == {2: {"empty run"}, 3: {"not in the chunk", "coverage", "no English"}, 4: {"translated already"}, 5: {"not in the chunk", "coverage", "no English"}, 6: {"empty run"}}


def test_chunk_headers(spark):
    verses = spark.createDataFrame([("Q 2:1", 2, "Cow", 1, "آية", " In the name "), ("Q 2:2", 2, "Cow", 2, "", None)], "ref string, surah int, name string, ayah int, arabic string, english string")
    assert [r.content for r in prose.verse_chunks(verses, "P").orderBy("ref").collect()] == ["Q 2:1 — Surah Cow, verse 1 of chapter 2\n\nTranslation (P):\nIn the name\n\nArabic:\nآية", "Q 2:2 — Surah Cow, verse 2 of chapter 2"]
    rows = spark.createDataFrame([("S 1", "Sahih", "Faith", None, "", None, "text"), ("S 2", "Sahih", "", None, None, "نص", "")], "ref string, collection string, book string, narrator string, grading string, arabic string, english string")
    assert [r.content for r in prose.collection_chunks(rows).orderBy("ref").collect()] == ["S 1 — Sahih (Faith)\n\nText:\ntext", "S 2 — Sahih\n\nArabic:\nنص"]


def test_best_by_tokens(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "xx"]) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    asked = [(1, "alpha beta"), (2, "nothing"), (3, ""), (4, "delta")]
    rows, q = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    sets = lambda t: {w for w in t.split() if len(w) > 2}
    want = set()
    for k, text in asked:
        a = sets(text)
        order = sorted(texts, key=lambda t: (-(len(a & sets(t[1])) / max(len(a | sets(t[1])), 1)), t[0]))
        want |= {(k, i) for i, _ in order[:7]}
    assert {(r.query_id, r.id) for r in retrieval.best_by_tokens(rows, q, 7).collect()} == want


def test_rendered_worksheets_are_read_back(spark, tmp_path):
    asked = spark.createDataFrame([("a", "Why?", ["how"], "look again", True), ("b", None, None, None, None), ("c", "no hits", [], "", False)], "slug string, question string, also array<string>, note string, decline boolean")
    hits = [("a", 0, 2, 7, "verse", "1:2", "T", " two \n", True), ("a", 1, 1, 7, "verse", "1:2", "T", " two \n", True), ("a", 1, 2, 5, "prose", "p. 3", "U", "five", False)]
    hits += [("a", 0, 1, 9, None, None, None, None, None), ("b", 0, 1, 4, "verse", "2:1", "T", "four", True), (None, 0, 1, 4, "verse", "2:1", "T", "four", True)]
    made = worksheets.rendered(asked, spark.createDataFrame(hits, "slug string, query int, rank int, chunk_id long, kind string, ref string, title string, text string, paged boolean"))
    value = {r.slug: r.value for r in made.collect()}
    assert sorted(value) == ["a", "b"] and "(chapter-level, no page)" in value["a"] and '- found via: "how"' in value["a"] and "Reviewer note: look again" in value["a"] and "found via" not in value["b"]
    sheets = made.select("slug", made.value.alias("text"))
    assert sorted(map(tuple, worksheets.passages(sheets).collect())) == [("a", 1, 9), ("a", 2, 7), ("a", 3, 5), ("b", 1, 4)]
    assert worksheets.citations(sheets).count() == 0
    readers.write_new(made, str(tmp_path / "sheets"))
    with pytest.raises(Exception, match="already exists"):
        readers.write_new(made, str(tmp_path / "sheets"))
