"""Readers, worksheets and the stream, on files made here."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import worksheets
from quern.sources import readers
from quern.streaming import misses


def test_manifest(spark):
    ok = {"id": "a", "title": "A", "kind": "fiqh", "uri": "0001X.Y"}
    df = readers.manifest(spark, [ok, ok | {"id": "b", "skip": True}], {"license": "free"})
    assert [r.id for r in readers.selected(df).collect()] == ["a"] and [r.id for r in readers.selected(df, ["b"]).collect()] == ["b"]
    for bad in ({"kind": "x"}, {"uri": None}, {"title": ""}):
        with pytest.raises(ValueError):
            readers.manifest(spark, [ok | bad], {"license": "free"} if "uri" not in bad else {})


def test_json_editions(spark, tmp_path):
    edition = {"surahs": [{"number": 1, "name": "n", "ayahs": [{"numberInSurah": i, "text": f"t{i}", "juz": 1, "page": 1} for i in (1, 2)]}, {"number": 2, "name": "m", "ayahs": []}]}
    (tmp_path / "a.json").write_text(json.dumps(edition))
    v = readers.verses(spark, str(tmp_path / "a.json"))
    assert [(r.surah, r.ayah, r.english) for r in readers.with_translation(v, v.where("ayah = 1")).orderBy("ayah").collect()] == [(1, 1, "t1"), (1, 2, "")]
    assert readers.verses(spark, str(tmp_path / "a.json"), 0).count() == 0
    long = " ".join(f"w{i}" for i in range(12))
    (tmp_path / "ar.json").write_text(json.dumps({"hadiths": [{"hadithnumber": 1, "text": long}, {"hadithnumber": 2, "text": "short"}]}))
    (tmp_path / "en.json").write_text(json.dumps({"hadiths": [{"hadithnumber": 1, "text": "old"}, {"hadithnumber": 1, "text": "new"}, {"hadithnumber": 2, "text": "x"}]}))
    assert [(r.number, r.english) for r in readers.collection(spark, str(tmp_path / "ar.json"), str(tmp_path / "en.json")).collect()] == [(1, "new")]


def test_line_files_and_writers(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("# c\n\nwhat\ta|b\nwhy\t-\n")
    assert {r.question: r.slugs for r in readers.expected(spark, str(tmp_path / "q.tsv")).collect()} == {"what": ["a", "b"], "why": []}
    (tmp_path / "quotes").write_text("7::a :: b\nnone\n")
    assert [tuple(r) for r in readers.quotes(spark, str(tmp_path / "quotes")).collect()] == [(7, "a :: b")]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "part string, v int")
    readers.write_parts(df, str(tmp_path / "t"), "part")
    readers.write_parts(spark.createDataFrame([("b", 3)], "part string, v int"), str(tmp_path / "t"), "part")
    assert sorted((r.part, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 1), ("b", 3)]
    cache = spark.createDataFrame([("m", "x")], "model string, text string").withColumn("key", F.sha2("text", 256))
    assert [r.text for r in readers.pending(spark.createDataFrame([("x",), ("y",), ("y",)], "text string"), cache, "m").collect()] == ["y"]


def test_worksheet_and_grounding(spark):
    text = '## Answer\nBody [1] <!-- no -->\n## Passages\n### Passage 1 — ref\n\n- kind: x · chunk: 42\n\n> text\n\n## Citations\n1. passage=1 quote="some words"\n'
    df = spark.createDataFrame([("s", text)], "slug string, text string")
    assert df.select(worksheets.section(F.col("text"), "Answer").alias("a")).first().a == "Body [1]"
    assert [tuple(r) for r in worksheets.passages(df).collect()] == [("s", 1, 42)]
    assert [tuple(r) for r in worksheets.citations(df).collect()] == [("s", 1, 1, "some words")]
    a = spark.createDataFrame([("See 2:255 and 3:1, Abi Dawud aside; Tirmidhi, Sahih\nMuslim and a Muslim.", ["on 2:255", "Sunan Abi Dawud"])], "t string, c array<string>")
    assert a.select(worksheets.unverified(F.col("t"), F.col("c")).alias("u")).first().u == ["3:1", "Tirmidhi", "Sahih Muslim"]


def test_inline_nodes(spark):
    long = "ب" * 61
    rows = [(1, "a **b** *c* `d` [2] e"), (2, ""), (3, None), (4, "**lead *in* `ا`**"), (5, "*two\nlines* *not\n\nthese*"), (6, "**ends *so***"), (7, f"`{long}` [1234]")]
    got: dict[int, list] = {}
    for r in worksheets.inline_nodes(spark.createDataFrame(rows, "id long, text string")).orderBy("id", "path").collect():
        got.setdefault(r.id, []).append((r.path, r.kind, r.text))
    assert [x[1:] for x in got[1]] == [("text", "a "), ("strong", None), ("text", "b"), ("text", " "), ("em", None), ("text", "c"), ("text", " "), ("code", "d"), ("text", " "), ("cite", "2"), ("text", " e")]
    assert 2 not in got and 3 not in got
    assert got[4] == [([0], "strong", None), ([0, 0], "text", "lead "), ([0, 1], "em", None), ([0, 1, 0], "text", "in"), ([0, 2], "text", " "), ([0, 3], "arabic", "ا")]
    assert got[5] == [([0], "em", None), ([0, 0], "text", "two\nlines"), ([1], "text", " *not\n\nthese*")]
    assert got[6] == [([0], "strong", None), ([0, 0], "text", "ends "), ([0, 1], "em", None), ([0, 1, 0], "text", "so")]
    assert got[7] == [([0], "arabic", long), ([1], "text", " [1234]")]


def test_daily_miss_rate(spark):
    log = spark.sql("select timestamp'2024-01-01 01:00:00' + make_interval(0,0,0,0,i) as created_at, i % 3 > 0 as matched from range(48) t(i)")
    assert [(r.total, r.missed) for r in misses.daily_miss_rate(log).orderBy("day").collect()] == [(23, 8), (24, 8), (1, 0)]
