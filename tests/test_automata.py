"""Terms, matching blocks, linkage, glossaries and the joins of sets and quotes against brute force."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import glossary, linkage, similar
from quern.operators.automata import Passage, Terms, matching_blocks


def test_matching_blocks_equal_the_library():
    rng = random.Random(1)
    for _ in range(600):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        a = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        b = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        if a and rng.random() < 0.5:
            at = rng.randrange(len(b) + 1)
            b[at:at] = a[rng.randrange(len(a)) :]
        want = [(m.a, m.b, m.size) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        assert matching_blocks(a, b) == matching_blocks(a, b, Passage(a)) == want


def test_matching_blocks_are_linear_in_the_text():
    passage, text = ["the", "of"] * 20, ["of", "the", "x"] * 50_000
    passes = 0
    inner = Passage.longest

    def counted(self, text, lo, hi):
        nonlocal passes
        passes += hi - lo
        return inner(self, text, lo, hi)

    Passage.longest = counted
    try:
        assert matching_blocks(passage, text)[0][2] == 2
    finally:
        Passage.longest = inner
    assert passes <= len(text) * len(passage)


def terms_by_hand(terms, text):
    pattern = "|".join(re.escape(t.lower()) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return re.findall(rf"(?<![^\W_])(?:{pattern})(?![^\W_])", text.lower()) if terms else []


def test_terms_leftmost_longest_whole_words():
    assert Terms(["riba", "riba al-fadl", "rak'ah"]).find("Riba al-fadl, tribal RIBA; two rak'ah") == ["riba al-fadl", "riba", "rak'ah"]
    rng = random.Random(2)
    for _ in range(400):
        words = ["a", "b", "ab", "c", "é", "_", "-", "'"]
        make = lambda n: "".join(rng.choice(words) + rng.choice([" ", "", " "]) for _ in range(rng.randint(1, n))).strip()
        terms = sorted({x for _ in range(rng.randint(1, 12)) if (x := make(4))})
        text = make(40)
        assert Terms(terms).find(text) == terms_by_hand(terms, text)
    assert Terms([]).find("a") == [] and Terms(["", " "]).find("a b - -") == [" "]


def test_glossary_of_thousands_of_terms(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    rows = [(" ".join(word() for _ in range(rng.randint(1, 3))), f"x{i % 50}", i) for i in range(5000)] + [(None, "x", 1), ("a", None, 2), ("", "x", 3)]
    texts = [(i, " ".join(word().upper() if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 200)))) for i in range(30)] + [(99, None), (98, "")]
    table = {}
    for term, expansion, _ in rows:
        if term and expansion:
            table.setdefault(term, []).append(expansion)
    g = spark.createDataFrame(rows, "term string, expansion string, place int").repartition(3)
    df = spark.createDataFrame(texts, "id long, text string").withColumn("e", glossary.finder(g)(F.col("text")))
    for r in df.withColumn("glossed", glossary.glossed(F.col("text"), F.col("e"))).collect():
        want = list(dict.fromkeys(", ".join(table[t]) for t in terms_by_hand(list(table), r.text or "")))
        assert r.e == want and r.glossed == (r.text + f" ({'; '.join(want)})" if want else r.text)


def test_glossary_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(glossary, "MOST_CHARS", 5)
    with pytest.raises(ValueError):
        glossary.finder(spark.createDataFrame([("term", "expansion", 1)], "term string, expansion string, place int"))


def greedy(matches):
    kept = []
    for m in sorted(matches, key=lambda m: (-m[2], m[3], m[4], m[1])):
        span = set(range(m[3], m[3] + m[4]))
        if not any(len(span & set(range(k[3], k[3] + k[4]))) > len(span) * 0.5 for k in kept):
            kept.append(m)
    return {(m[0], m[1]) for m in kept}


def test_islands_resolve_as_the_plain_greedy(spark):
    rng = random.Random(4)
    rows = [(t, p, round(rng.choice([0.6, 0.7, 0.8, 1.0]), 2), rng.randrange(300), rng.randint(8, 40), "m") for t in range(12) for p in range(rng.choice([1, 5, 40]))]
    df = spark.createDataFrame(rows, "text_id long, passage_id long, coverage double, start long, span long, matched string")
    want = set().union(*(greedy([r for r in rows if r[0] == t]) for t in range(12)))
    assert {(r.text_id, r.passage_id) for r in linkage.resolved(df).collect()} == want


def linked_by_hand(passages, texts):
    out = set()
    for t, text in texts:
        b = re.findall(r"\w+", text.lower())
        matches = []
        for p, passage in passages:
            a = re.findall(r"\w+", passage.lower())
            hits = sum(a[i : i + 8] == b[j : j + 8] for i in range(0, len(a) - 7, 3) for j in range(len(b) - 7))
            if hits < 2:
                continue
            blocks = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= 4]
            longest = max(blocks, key=lambda m: m.size)
            coverage = sum(m.size for m in blocks) / len(a)
            if coverage >= 0.6 and longest.size >= 8:
                matches.append((t, p, round(coverage, 4), blocks[0].b, blocks[-1].b + blocks[-1].size - blocks[0].b, " ".join(b[longest.b : longest.b + longest.size])))
        kept = greedy(matches)
        out |= {m for m in matches if m[:2] in kept}
    return out


def test_linkage_as_a_whole(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("the of and w1 w2 w3 w4 w5 w6 w7 w8 w9".split())
    passages = [(i, " ".join(word() for _ in range(rng.randint(6, 40)))) for i in range(15)]
    texts = []
    for t in range(25):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            own = rng.choice(passages)[1].split()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(["x", "the"])
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        texts.append((t, ", ".join(w)))
    p, d = spark.createDataFrame(passages, "passage_id long, text string"), spark.createDataFrame(texts, "text_id long, text string")
    pairs = linkage.candidates(p, d).join(p.withColumnRenamed("text", "passage"), "passage_id").join(d, "text_id")
    got = {(r.text_id, r.passage_id, r.coverage, r.start, r.span, r.matched) for r in linkage.resolved(linkage.verified(pairs)).collect()}
    want = linked_by_hand(passages, texts)
    assert got == want and len(want) > 5


def test_similar_equals_the_full_join(spark):
    rng = random.Random(7)
    sets = [(i, [f"m{min(int(rng.expovariate(0.15)), 60)}" for _ in range(rng.randint(0, 25))]) for i in range(120)] + [(500, None), (501, [])]
    df = spark.createDataFrame(sets, "id long, members array<string>")
    for threshold in (0.3, 0.5, 0.8, 1.0):
        got = {(r.left_id, r.right_id, round(r.similarity, 9)) for r in similar.similar(df.where("id % 3 = 0"), df, threshold).collect()}
        want = set()
        for i, a in sets:
            for j, b in sets:
                x, y = set(a or []), set(b or [])
                if i % 3 == 0 and x and y and len(x & y) / len(x | y) >= threshold:
                    want.add((i, j, round(len(x & y) / len(x | y), 9)))
        assert got == want


def test_similar_does_not_meet_on_what_all_have(spark):
    sets = spark.createDataFrame([(i, ["all", "every", f"own{i}", f"other{i}"]) for i in range(300)], "id long, members array<string>")
    rarity = sets.select("id", F.explode("members").alias("member")).groupBy("member").agg(F.count(F.lit(1)).alias("df"))
    kept = similar.prefixes(sets.select("id", F.explode("members").alias("member")), rarity, 0.75)
    assert kept.where("member in ('all', 'every')").count() == 0
    assert similar.similar(sets, sets, 0.75).count() == 300


@pytest.mark.parametrize("by_ref", [False, True])
def test_quotes_of_all_lengths(spark, by_ref):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "forward", "ward", "war", "evil", "آية", "x1", "quite", "rare", "words"])
    texts = [(i, f"r{i % 4}", ", ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(200, "r1", None), (201, "r1", "")]
    quotes = []
    for n in range(1, 13):
        for _ in range(6):
            i, r, text = rng.choice(texts[:60])
            bare = re.sub(r"[^\w\s]", "", text).split()
            at = rng.randrange(max(1, len(bare) - n + 1))
            cut = " ".join(bare[at : at + n])
            cut = cut[rng.choice([0, 0, 1]) : len(cut) - rng.choice([0, 0, 1]) or None]
            quotes.append((len(quotes), r, cut.upper() + rng.choice(["", ".", " (!)"])))
    quotes += [(300, "r1", None), (301, "r1", ""), (302, "r1", "..."), (303, "r2", "nowhere to be found"), (304, "r9", "the")]
    q, d = spark.createDataFrame(quotes, "quote_id long, ref string, quote string"), spark.createDataFrame(texts, "text_id long, ref string, text string")
    bare = lambda c: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", (c or "").lower()))
    want = {(k, i) for k, s, quote in quotes for i, r, text in texts if bare(quote).strip() and text is not None and bare(quote) in bare(text) and (s == r or not by_ref)}
    assert {(r.quote_id, r.text_id) for r in similar.containing(q, d, by_ref).collect()} == want
    assert q.select(T.database_words(F.col("quote")).alias("w")).count() == len(quotes)
