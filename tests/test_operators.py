"""Operators that the tables of the queries can't show: the parser, linkage, searches, tables, text functions."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers, linkage, markup, matching, retrieval, tables


HEAD = "#META# 010.AuthorNAME\t:: A\n#META# 020.BookTITLE\t:: B\n#META# 020.BookTITLESUB\t:: NODATA\n#META#Header#End#\n"
# (work, blocks as (heading, text, volume, page)): every kind of line and of page mark, and depths that are skipped.
WORKS = [
    ("### | First\n# one one\n~~two\nPageV01P001\n### || Inner\nthree PageV01P002 four\n=====\nfive\n\n# six PageV00P000 seven\n### $ entry\nPageV02P010\n### | Second PageV02P011\nlast", [
        ("First", "one one two", 1, 1), ("First › Inner", "three", 1, 2), ("First › Inner", "four five", 2, 10), ("First › Inner", "six", 2, 10), ("First › Inner", "seven", 2, 10), ("First › Inner", "entry", 2, 10), ("Second", "last", 2, None),
    ]),
    ("### | One\n### |||| Deep\n### ||| Mid\ntext\n### || Up\nmore", [("One › Deep › Mid", "text", None, None), ("One › Up", "more", None, None)]),
    ("### ||| First at three\na\n\n### || Then two\nb\n### |||||||| Eight\nc\n### ||\nd", [("First at three", "a", None, None), ("First at three › Then two", "b", None, None), ("First at three › Then two › Eight", "c", None, None), ("First at three", "d", None, None)]),
    ("a\nb\n\nc PageEndV01P408 d\nPageV01P409\ntail", [("", "a b", 1, 408), ("", "c", 1, 408), ("", "d", 1, 409), ("", "tail", 1, None)]),
    ("### |EDITOR|\n# x %~% y ms12 @QB@ q @QE@\nms0100\n# z ____\n#####\n<div id='x'>\n# p <b>q</b> r PageV0MP001\n</div>\nPageV02P007", [("EDITOR", "x   y   q", 2, 7), ("EDITOR", "z", 2, 7), ("EDITOR", "p  q  r", 2, 7)]),
    ("### || Book\n### $ one\n### $ two\nPageV01P003\n|| ( 1 shown )\n# the psalms 12 and hakams 3 remain", [("Book", "one", 1, 3), ("Book", "two", 1, 3), ("Book", "( 1 shown )", 1, None), ("Book", "the psalms 12 and hakams 3 remain", 1, None)]),
    ("### | A PageV01P005\ntext\n### | B PageV01P006 C PageV03P001\nmore\n \t \nend", [("A", "text", 1, 6), ("B   C", "more", 3, None), ("B   C", "end", 3, None)]),
    ("", []), ("PageV01P001\n\n=====", []),
]


@pytest.mark.parametrize("header", [HEAD, HEAD.replace("#META#Header#End#\n", ""), ""])
def test_parser_of_all_cases(spark, header):
    works = spark.createDataFrame([(i, header + text) for i, (text, _) in enumerate(WORKS)] + [(99, None)], "work long, text string")
    lines = markup.lines(works)
    got = {}
    for r in markup.parse(lines).orderBy("work", "block").collect():
        got.setdefault(r.work, []).append((r.heading, " ".join(r.text.split()), r.volume, r.page))
    tidy = lambda rows: [(" ".join(h.split()), " ".join(t.split()), v, p) for h, t, v, p in rows]
    assert {k: [(" ".join(h.split()), t, v, p) for h, t, v, p in rows] for k, rows in got.items()} == {i: tidy(b) for i, (_, b) in enumerate(WORKS) if b}
    meta = {(r.key, r.value) for r in markup.meta(lines).collect()}
    assert meta == ({("010.AuthorNAME", "A"), ("020.BookTITLE", "B")} if header else set())


def test_parser_goes_on_over_batches(spark):
    text = "### | T\n" + "\n".join(f"# p{i}\n~~q{i}\nPageV01P{i + 1}" for i in range(300)) + "\n# end"
    works = spark.createDataFrame([(1, text), (2, text)], "work long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [(r.work, r.text, r.page) for r in markup.parse(markup.lines(works)).orderBy("work", "block").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(w, *x) for w in (1, 2) for x in [*((f"p{i} q{i}", i + 1) for i in range(300)), ("end", None)]]


def test_parser_has_one_exchange(spark):
    lines = markup.lines(spark.createDataFrame([(1, "x")], "work long, text string"))
    assert markup.parse(lines)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_classical_chunks_carry_pages_over_cuts(spark):
    long = " ".join(f"{i} " + "a" * 400 + "." for i in range(20))
    rows = [(1, 1, "H", "first", 1, 3), (1, 2, "H", "second", 1, 5), (1, 3, "I", long, 2, 7), (1, 4, "I", "end", 2, 7), (1, 5, "I", "  ", 2, 8), (2, 1, None, "no page", 3, None), (3, 1, "", "front", 0, 12), (4, 1, "", None, 1, 1)]
    blocks = spark.createDataFrame(rows, "work long, block int, heading string, text string, volume int, page int")
    titles = spark.createDataFrame([(i, f"W{i}") for i in range(1, 5)], "work long, title string")
    got = markup.classical_chunks(blocks, titles, together=False).orderBy("work", "ordinal").collect()
    refs = [(r.work, r.ordinal, r.ref, r.heading) for r in got]
    assert refs[0] == (1, 0, "W1 1:3-5", "H") and {r[2] for r in refs[1:-2]} == {"W1 2:7"} and refs[-2:] == [(2, 0, "W2", ""), (3, 0, "W3 0:12", "")]
    assert [r[1] for r in refs[:-2]] == list(range(len(refs) - 2)) and all(r.token_count < 720 for r in got)
    body = lambda r: r.content.split("Arabic:\n")[1]
    assert got[0].content == "W1 1:3-5 — H\n\nArabic:\nfirst\n\nsecond"
    assert " ".join(body(r) for r in got[1:-2]).replace("\n\n", " ") == long + " end"
    found, clash = markup.volumes(markup.classical_chunks(blocks, titles, together=False), titles)
    assert sorted((r.work, r.ref, r.ordinal) for r in found.collect()) == [(1, "W1 vol. 1", 0), (1, "W1 vol. 2", 1), (2, "W2 (unpaginated)", 0), (3, "W3", 0)] and clash.count() == 0
    same = spark.createDataFrame([(2, "W"), (3, "W (unpaginated)")], "work long, title string")
    assert [r.ref for r in markup.volumes(markup.classical_chunks(blocks, same, together=False), same)[1].collect()] == ["W (unpaginated)"]


def test_pack_starts_anew_at_headings_and_budget(spark):
    rows = [(1, i + 1, "a" if i < 5 else "b", c) for i, c in enumerate([300, 300, 100, 700, 10, 640, 20])]
    got = markup.pack(spark.createDataFrame(rows, "work long, block int, heading string, cost int")).orderBy("block").collect()
    assert [(r.run, r.part) for r in got] == [(1, 0), (1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]


def test_linkage_finds_a_contained_passage(spark):
    words = [f"w{i}" for i in range(40)]
    passages = spark.createDataFrame([(1, " ".join(words[:20]))], "passage_id long, text string")
    texts = spark.createDataFrame([(7, "x y z " + " ".join(words) + " q"), (8, "nothing alike here at all")], "text_id long, text string")
    c = linkage.candidates(passages, texts)
    assert [(r.passage_id, r.text_id) for r in c.collect()] == [(1, 7)]
    pairs = c.join(passages.withColumnRenamed("text", "passage"), "passage_id").join(texts, "text_id")
    got = linkage.resolved(linkage.verified(pairs)).collect()
    assert [(r.text_id, r.passage_id, r.coverage, r.start, r.span) for r in got] == [(7, 1, 1.0, 3, 20)]


def test_resolve_drops_what_overlaps_a_better_match(spark):
    rows = [(1, 10, 0.9, 0, 10, "a"), (1, 11, 0.8, 4, 10, "b"), (1, 12, 0.7, 9, 10, "c")]
    df = spark.createDataFrame(rows, "text_id long, passage_id long, coverage double, start long, span long, matched string")
    assert sorted(r.passage_id for r in linkage.resolved(df).collect()) == [10, 12]


def test_arabic_normalisation_is_idempotent(spark):
    raw = ["وَإِذَا ضَرَبْتُمْ فِي الْأَرْضِ", "﴿١٢﴾", "é", "", None]
    df = spark.createDataFrame([(x,) for x in raw], "raw string").select(T.normalize_arabic(F.col("raw")).alias("a"))
    df = df.withColumn("b", T.normalize_arabic(F.col("a")))
    got = df.collect()
    assert got[0].a == "واذا ضربتم في الارض" and got[1].a == "12" and got[4].a == ""
    assert all(r.a == r.b for r in got)


def test_zero_vectors_are_never_near(spark):
    rows = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "a", None)], "id long, kind string, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r.id for r in retrieval.vector_arm(rows, q).collect()] == [2]


def test_ladder_overrides_distance_and_offers_near_ties(spark):
    rows = [(1, 5, 0.95, 0.5), (1, 6, 0.93, 0.5), (2, 5, 0.8, 0.5), (3, 5, 0.05, 0.1), (4, 5, 0.4, 0.1), (4, 6, 0.1, 0.1)]
    got = {r.query_id: (r.outcome, r.answer_id, r.confident, r.alternatives) for r in matching.decide(spark.createDataFrame(rows, "query_id long, answer_id long, score double, nearest double")).collect()}
    assert got == {1: ("hit", 5, True, [6]), 2: ("miss", None, False, []), 3: ("miss", None, False, []), 4: ("hit", 5, False, [6])}


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted((r.k, r.v) for r in tables.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted((r.k, r.v) for r in tables.insert_missing(old, new, ["k"], ["v"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted((r.k, r.v) for r in tables.drop_stale(old, new, ["k"]).collect()) == [(2, "b")]


def test_intervals_touch_and_merge(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 8)], "k int, lo int, hi int")
    assert sorted((r.lo, r.hi) for r in answers.merge_intervals(df, ["k"], "lo", "hi").collect()) == [(0, 5), (7, 8)]
