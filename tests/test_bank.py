"""English stems, backends, prose packing, the bank's guards and stored tables, against examples and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.functions import english
from quern.operators import backends, bank, prose, retrieval
from quern.sources import readers, schemas

SF = "/root/testdata/sf0.001"
# Examples of the published description of the stemmer.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistently consist
consolation consol consolatory consolatori consolidate consolid consoling consol consonant conson consort consort conspicuous conspicu conspiracy conspiraci
conspirators conspir constable constabl constancy constanc knack knack knackeries knackeri knaves knave kneaded knead kneeling kneel knightly knight knits knit
knitted knit knocker knocker knopp knopp skies sky dying die inning inning generously generous hopping hop hoping hope relational relat agreed agre gas gas""".split()


@pytest.mark.parametrize("word, want", list(zip(STEMS[::2], STEMS[1::2])))
def test_stem(word, want):
    assert english.stem(word) == want


def test_english_arm_is_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(-1, None), (-2, ""), (-3, "The of and"), (-4, "Walking walked WALKS")]
    asked = [(0, "walk the dogs"), (1, "the and of"), (2, docs[1][1]), (3, None)]
    rows, queries = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    got = {(r.query_id, r.id): round(r.score, 6) for r in retrieval.english_arm(rows, queries, limit=10_000).collect()}
    lexemes = lambda t: [english.stem(w) for w in re.split(r"[\W_]+", (t or "").lower()) if w and w not in english.STOP_WORDS]
    want = {}
    for i, text in docs:
        n = Counter(lexemes(text))
        for q, words in asked:
            if score := sum(n[x] for x in set(lexemes(words))):
                want[q, i] = round(0.1 * score, 6)
    assert got == want and got[0, -4] == 0.3


def test_prose_overlap_and_limits():
    units = [f"{i:02d} " + "x" * 300 for i in range(30)]  # 76 tokens each
    out = prose.packed(units, prose.TARGET, "\n\n", prose.OVERLAP)
    assert all(a.split("\n\n")[-1] == b.split("\n\n")[0] for a, b in zip(out, out[1:]))
    assert sorted({u for x in out for u in x.split("\n\n")}) == units
    long = " ".join(["word"] * 2000)
    assert [len(p.split()) for p in prose.pieces(long)] == [382] * 4 + [382 + 90]  # the last run fits into the one before
    assert prose.pieces("short") == ["short"] and prose.packed([], 650, " ") == []
    sentences = " ".join(f"{i} {'a' * 400}." for i in range(20))
    assert " ".join(prose.pieces(sentences)) == sentences and len(prose.pieces(sentences)) > 1


def test_prose_of_awkward_rows(spark):
    rows = [(1, 0, "Ref", "H", None), (2, 0, "Ref", None, ""), (3, 0, "Ref", "", "a\n\n\n\nb\r\n\r\nc"), (4, 0, "Ref", "H", "آية"), (4, 1, "Ref", "I", "x")]
    got = prose.chunk_prose(spark.createDataFrame(rows, "work long, section int, ref string, heading string, body string")).collect()
    assert {(r.work, r.section, r.part): r.content for r in got} == {(3, 0, 0): "Ref\n\nText:\na\n\nb\n\nc", (4, 0, 0): "Ref — H\n\nText:\nآية", (4, 1, 0): "Ref — I\n\nText:\nx"}


def test_offline_vectors_by_definition(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, " "), (4, "a"), (5, "é")], "id long, text string")
    got = {r.id: r.v for r in df.select("id", backends.embedder(backends.offline)("text").alias("v")).collect()}
    draw = random.Random(int.from_bytes(hashlib.sha256(b"a").digest()[:8], "big")).gauss
    v = [draw(0, 1) for _ in range(backends.DIMENSIONS)]
    size = math.sqrt(sum(x * x for x in v))
    assert got[1] == pytest.approx([x / size for x in v], abs=1e-6) and got[1] == got[4] != got[5]
    assert got[2] is None and got[3] is None


def test_backend_of_wrong_dimensions(spark):
    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception, match="numbers for 1 texts of 3"):
        df.select(backends.embedder(backends.offline, 3)("text")).collect()
    with pytest.raises(ValueError):
        backends.embedder(backends.offline, batch=backends.BATCH + 1)


def test_embedded_fills_a_cache(spark, tmp_path):
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("",)], "text string")
    path = str(tmp_path / "cache")
    empty = spark.createDataFrame([], schemas.newest("embedding_cache"))
    readers.append_rows(backends.embedded(texts, empty, "m", backends.offline), path)
    cache = spark.read.parquet(path)
    assert cache.count() == 2 and backends.embedded(texts, cache, "m", backends.offline).count() == 0
    assert backends.embedded(texts, cache, "other", backends.offline).count() == 2


def test_publishing_needs_one_of_two(spark):
    answers = spark.createDataFrame([(1, "draft", None), (2, "published", "x")], "id long, status string, reviewed_by string")
    none = spark.createDataFrame([], "id long, reason string, n long")
    for reviewer, unreviewed in ((None, False), ("x", True)):
        with pytest.raises(ValueError):
            bank.publish(answers, answers.select("id"), none, reviewer, unreviewed)
    back = {r.id: (r.status, r.reviewed_by) for r in bank.unpublish(answers, answers.select("id")).collect()}
    assert back == {1: ("draft", None), 2: ("draft", None)}


def test_pins_and_deletions_belong_to_owners(spark):
    rows = spark.createDataFrame([(1, 7, None), (2, 7, 5), (3, None, None)], "id long, user_id long, pinned_at long")
    asked = spark.createDataFrame([(1, 7, True, 9), (1, 7, True, 11), (1, 8, False, 12), (2, 7, False, 3), (3, None, True, 4)], "id long, user_id long, pin boolean, at long")
    assert {r.id: r.pinned_at for r in bank.pinned(rows, asked).collect()} == {1: 11, 2: None, 3: None}
    assert {r.id for r in bank.removed(rows, asked.where("pin = false")).collect()} == {1, 3}


def test_licence_deeds(spark):
    df = spark.createDataFrame([("Text CC BY-NC-SA 4.0.",), ("cc by 3.0",), ("CC0",), ("",), (None,)], "a string")
    assert [r[0] for r in df.select(bank.licence_deed(F.col("a"))).collect()] == ["https://creativecommons.org/licenses/by-nc-sa/4.0/", "https://creativecommons.org/licenses/by/3.0/", None, None, None]


def test_question_lists_and_torn_lines(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"slug": "a", "question": "A?"}, {"slug": "b", "question": "B?"}]')
    rows = readers.listed(str(tmp_path / "q.json"))
    assert readers.questions(spark, rows).count() == 2
    for bad in ([*rows, rows[0]], [{"slug": "c"}]):
        with pytest.raises(ValueError):
            readers.questions(spark, bad)
    (tmp_path / "c.jsonl").write_text('{"key": "k", "embedding": [1, 2]}\n{"key": "k", "embedding": [1, 2]}\n{"key": "l", "embed')
    assert [(r.key, r.model, r.embedding) for r in readers.cached_lines(spark, str(tmp_path / "c.jsonl"), "m").collect()] == [("k", "m", [1.0, 2.0])]


def test_tsv_and_whole_texts(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("uri\ttitle\n0256Bukhari.Sahih\tSahih\n")
    row = readers.tsv(spark, str(tmp_path / "m.tsv")).first()
    assert (row.uri, row.title) == ("0256Bukhari.Sahih", "Sahih")
    parts = spark.createDataFrame([("0256Bukhari.Sahih",), ("0250A.B",), ("none",)], "uri string").select(*[c.alias(k) for k, c in readers.version_parts(F.col("uri")).items()]).collect()
    assert [tuple(p) for p in parts] == [(256, "Bukhari", "Sahih", 275), (250, "A", "B", 250), (None, "", "", None)]
    (tmp_path / "w.txt").write_text("######\n#META# x :: y\n")
    got = readers.whole_texts(spark, str(tmp_path / "w.txt")).select("text", readers.looks_marked_up(F.col("text")).alias("m")).collect()
    assert len(got) == 1 and got[0].m and got[0].text.count("\n") == 2


def test_old_tables_conform(spark):
    old = spark.createDataFrame([("q", True, None)], schemas.VERSIONS["query_log"][0])
    assert schemas.version(old, "query_log") == 1
    new = schemas.conform(old, "query_log")
    assert new.columns == schemas.newest("query_log").names and new.first().score is None and schemas.version(new, "query_log") == 2
    assert schemas.conform(spark.createDataFrame([(1, "s", "q", "b", None)], schemas.VERSIONS["answers"][0]), "answers").first().status == "draft"
    with pytest.raises(ValueError):
        schemas.conform(spark.createDataFrame([(1,)], "x int"), "answers")


def test_against_in_blocks(spark):
    rows, few = spark.range(7), spark.range(50).select(F.col("id").alias("q"))
    for block in (50, 20, 3):
        got = retrieval.against(rows, few, block)
        assert got.count() == 350 == got.distinct().count()
