"""Operators of quern.llm against brute force, round trips and held-out documents, with awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quern.llm import common, forest, jaccard, licences, lines, links, lm, mixing, pieces, quality, repeats, tokens  # noqa: E402
from quern.llm.common import Scratch, components  # noqa: E402

SF = "/root/testdata/sf0.001"
AWKWARD = [(900, None, "en", None), (901, "", "en", "s"), (902, "  \n\t ", "en", "s"), (None, "some words in a row without an id", "en", "s"), (903, "x" * 30_000 + " é" * 5_000, "en", "t"), (904, "same row", "en", "s"), (904, "same row", "en", "s")]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


def test_licences_base_places_and_spans():
    scan = licences.Scanner()
    n, places, spans = scan(b"CC BY-NC and All Rights Reserved, cc by cc by. Licensed under the Apache License, Version 2.0.")
    assert sorted((scan.labels[k], s) for k, s in places) == [("cc-by", 0), ("cc-by", 7), ("cc-by", 9), ("reserved", 4)]
    assert ("apache-2.0", 11, 19, 1.0) in spans
    assert n == 19 and scan(b"") == (0, [], [])
    rng = random.Random(1)
    vocabulary = "cc by all rights reserved general public license the under of x".split()
    for _ in range(300):
        words = [rng.choice(vocabulary) for _ in range(40)]
        got = scan(" ".join(words).encode())[1]
        want = [(k, i) for k, (p, _) in enumerate(licences.BASE) for i in range(40) if words[i : i + len(p.split())] == p.split()]
        assert sorted(got) == sorted(want)


def test_licences_awkward_rows(spark):
    got = {r.doc_id: r for r in licences.scan(docs_of(spark, AWKWARD)).collect()}
    assert got[900].n_words == 0 and got[900].labels == "" and got[900].first_word is None and got[901].score == 0.0


def test_pieces_equal_the_library_and_round_trip(rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    texts = [t for _, t in rows] + ["", " ", "  a  b", "a\nb\tc", "日本語 é́ \x00", "aaaa" * 4000, "the.,;word!? x" * 50, "ab▁c"]
    for t in texts:
        assert own.encode(t) == sp.encode(t)
        assert own.decode(own.encode(t)) == t.replace("▁", " ")


def test_pieces_of_long_units_and_blocks(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    monkeypatch.setattr(pieces, "BLOCK", 500)
    rng = random.Random(7)
    texts = ["".join(rng.choice(kind) for _ in range(rng.randint(1, 900))) for kind in ("etaoinshr", "abcdefghijklmnopqrstuvwxyz", "éèaenst", "the\u0301 日本語x", "aA1_.,- \n", " ") for _ in range(40)]
    got = own.encode_all([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [sp.encode(t) for t in texts]


def test_pieces_stream_keeps_a_bounded_window():
    own = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    text = "thequickbrownfox" * 500
    taken = 0

    def chars():
        nonlocal taken
        for c in text:
            taken += 1
            yield c

    first_at = None
    out = []
    for p in own.stream(chars()):
        first_at = first_at or taken
        out.append(p)
    assert "".join(out) == text and first_at <= 8 * own.longest and out == own.merged(text[:160])[: len(own.merged(text[:160])) - 4] + out[len(own.merged(text[:160])) - 4 :]


def brute_repeats(rows, length=repeats.LENGTH):
    first, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b, to, gone = (t or "").encode(), 0, []
        for i in range(len(b)):
            if i + length <= len(b) and first.setdefault(b[i : i + length], (d, i)) < (d, i):
                to = i + length
            gone.append(i < to)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_against_brute_force(spark, documents, rows, monkeypatch):
    want = brute_repeats(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.dedup(documents, texts=False).collect()} == want
    rng = random.Random(3)
    made = [(d, "".join(rng.choice(["ab" * rng.randint(1, 300), "x" * rng.randint(1, 400), "".join(rng.choice("abc é") for _ in range(200))]) for _ in range(rng.randint(0, 5)))) for d in range(50)]
    made += [(100 + i, rng.choice(made)[1][rng.randint(0, 40) :]) for i in range(30)]
    monkeypatch.setattr(repeats, "CHUNK", 5_000)
    got = repeats.dedup(spark.createDataFrame(made, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(made)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_awkward_rows(spark):
    got = repeats.dedup(docs_of(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and {r.n_removed for r in got if r.doc_id == 904} == {0}


def test_forest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((400, 16))
    near = base[:60] + 0.02 * rng.standard_normal((60, 16))
    x = np.concatenate([base, near, base[:10], 3 * base[10:12]])
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, 2.0]), (1004, [None] * 16)]
    got = {r.vec_id: r for r in forest.near(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    adjacent = u @ u.T >= 0.95
    np.fill_diagonal(adjacent, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.9 * adjacent.sum() <= found <= adjacent.sum()
    assert all(got[i].n_links <= adjacent[i].sum() for i in range(len(x)))
    for i in (1000, 1001, 1002, 1004):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[400].component_id == 0 and not got[400].kept


@pytest.mark.parametrize("n", [10_000, 60_000])
def test_forest_recall_and_copies_of_deep_trees(n):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((n // 10, 64))
    base = x[: n // 10]
    z -= (z * base).sum(1, keepdims=True) * base
    c = rng.uniform(0.95, 0.97, (n // 10, 1))
    x = np.concatenate((x, c * base + np.sqrt(1 - c * c) * z / np.linalg.norm(z, axis=1, keepdims=True)))
    trees = forest.Forest(x[rng.choice(len(x), min(len(x), forest.SAMPLE), replace=False)], len(x), 0.95)
    row, code = trees.leaves(x)
    assert trees.depth >= 4 and len(row) <= 16 * len(x) and np.unique(code, return_counts=True)[1].max() <= 2 * forest.LEAF
    at = np.searchsorted(row, np.arange(len(x) + 1))
    met = [len(np.intersect1d(code[at[i] : at[i + 1]], code[at[n + i] : at[n + i + 1]])) > 0 for i in range(n // 10)]
    assert sum(met) >= 0.95 * len(met)


@pytest.mark.parametrize("n", [10**7, 10**9])
def test_forest_recall_of_tables_of_any_size(n):
    """Of a table that is simulated by its number of rows: the depth is that of n vectors, pairs and copies are measured."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    trees = forest.Forest(unit(rng.standard_normal((forest.SAMPLE, 64))), n, 0.95)
    base = unit(rng.standard_normal((1500, 64)))
    row, code = trees.leaves(np.concatenate((base, forest.Forest.partners(base, 0.95, rng))))
    own = set(zip(row.tolist(), code.tolist()))
    met = np.zeros(1500, bool)
    met[[r for r, c in own if r < 1500 and (r + 1500, c) in own]] = True
    assert met.mean() >= 0.9 and len(trees.cuts) <= forest.MOST_TREES and len(row) <= 80 * len(base) * 2


def test_forest_repeated_and_null_ids(spark):
    made = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [1.0, 0.01]), (None, [1.0, 0.0]), (7, [-1.0, 0.0])]
    got = [tuple(r) for r in forest.near(spark.createDataFrame(made, "vec_id long, embedding array<double>").withColumnRenamed("x", "leaf")).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 0, None, True), (7, 0, 7, True)], key=str)
    assert forest.near(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_forest_large_leaves_and_small_ones(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((60, 8)) + 0.01 * rng.standard_normal((60, 8)), rng.standard_normal((100, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in forest.near(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert [got[i] for i in range(60)] == want[:60].tolist()


def test_lines_keep_one_of_each_group(spark):
    a = "the first long line of a document that comes back later on"
    made = [(1, f"{a}\nshort\nanother line that is found here alone, long enough"), (2, f"{a}s\nshort"), (3, f"  {a}  \n{a}"), (4, None), (5, ""), (None, a)]
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame([(*r, "c", 7) for r in made], "doc_id long, text string, n_lines string, x int")).collect()}
    assert got[1].n_removed == 0 and got[2].text == "short" and got[3].text == "" and got[3].n_removed == 2
    assert got[4].text is None and got[5].text == "" and got[None].n_removed == 0 and got[1].x == 7


def template_lines(rng, variants):
    """Lines of 60 words, each but the first with one word changed."""
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)]
    out = [" ".join(words)]
    while len(out) < variants:
        w = list(words)
        w[rng.randrange(60)] = "".join(rng.choice("qrstuvwxyz") for _ in range(6))
        out.append(" ".join(w))
    return out


def test_lines_of_large_groups_against_brute_force(spark):
    rng = random.Random(6)
    made = [x for n in (1, 2, 3, 10, 1000) for x in template_lines(rng, n)]
    rng.shuffle(made)
    sets, first = [lines.grams(x.encode()) for x in made], []
    up = common.Unions()
    for i, x in enumerate(sets):
        for j in first:
            if up.find(i) != up.find(j) and links.similar(x, sets[j], lines.NUM, lines.DEN):
                up.join(i, j)
        if up.find(i) == i:
            first.append(i)
    want = {i for i in range(len(made)) if up.find(i) != i}
    assert len(made) - len(want) == 5
    got = lines.dedup(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id for r in got if r.n_removed} == want


def test_op5_lines_takes_short_lines_too(spark, tmp_path):
    import corpus_pipeline as cp

    made = ["All rights reserved.\nab\none", "ab\n  All rights reserved. \n\ntwo", "é\n\nab\n日本語で", "é\naé\n日本語で\n\nthree"]
    spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").selectExpr("*", "length(text) as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    want = {0: made[0], 1: "\ntwo", 2: "é\n\n日本語で", 3: "aé\n\nthree"}
    got = {r.doc_id: r for r in lines.op5_lines(spark, str(tmp_path)).collect()}
    assert {d: r.kept_sha256 for d, r in got.items()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}
    assert [got[d].n_removed for d in range(4)] == [0, 2, 1, 2]
    assert {r.doc_id: r.text for r in cp.line_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()} == want


def test_compared_needs_every_text(spark):
    pairs, items = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), spark.createDataFrame([(1, "x"), (2, "x")], "id long, text string")
    with pytest.raises(Exception, match="no text for 1"):
        links.compared(pairs, items, lambda t: np.frombuffer(t, np.uint8), 1, 1).collect()


def test_line_signatures_catch_similar_lines():
    rng = random.Random(2)
    hit = total = 0
    for _ in range(400):
        a = "".join(rng.choice("abcdefghij klmno") for _ in range(rng.randint(40, 300)))
        b = list(a)
        for _ in range(max(1, len(a) // 60)):
            b[rng.randrange(len(b))] = "#"
        b = "".join(b)
        if links.similar(lines.grams(a.encode()), lines.grams(b.encode()), lines.NUM, lines.DEN):
            total += 1
            s = lines.signatures([a.encode(), b.encode()])
            hit += bool((s[0] == s[1]).any())
    assert total > 100 and hit >= 0.97 * total


def test_mixing_shares_and_stream(spark):
    made = [(i, "w " * (1 + i % 7), "en", f"s{i % 3}") for i in range(300)] + AWKWARD
    df = docs_of(spark, made)
    got = mixing.taken(df).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
        s = by.setdefault((r.source_size, r.target), 0)
        by[r.source_size, r.target] = s + r.taken
    assert len(got) == len(made)
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in mixing.taken(df.repartition(7)).collect())
    s = mixing.stream(df.withColumn("copy", df.doc_id)).collect()
    assert all(a.finish <= b.finish for a, b in zip(s, s[1:]))
    assert mixing.taken(docs_of(spark, [])).collect() == []


def test_mixing_stream_counts_repeated_rows(spark):
    made = [(i, "w " * (1 + i % 7), "en", f"s{i % 3}") for i in range(60)] + [(3, "a b c d", "en", "s0")] * 20 + [(None, "e f", "en", None)] * 5
    df = docs_of(spark, made)
    words = lambda rows: sorted((r.doc_id or -1, r.taken) for r in rows if r.taken)
    got = mixing.stream(df).groupBy("doc_id").agg({"taken": "sum"}).toDF("doc_id", "taken").collect()
    assert words(got) == words(mixing.taken(df).groupBy("doc_id").agg({"taken": "sum"}).toDF("doc_id", "taken").collect())
    assert mixing.stream(df).columns == [*df.columns, "size", "copy", "finish", "taken"]


def test_lm_base_and_bits(spark, documents, rows):
    c = Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 10:
            c.update(t.encode().lower().split())
            c[b"\0"] += 1
    n, floor = sum(c.values()), math.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    got = lm.score(documents).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        ws = [*text[r.doc_id].encode().lower().split(), b"\0"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10(c[w] + 0.1) - floor for w in ws), rel_tol=1e-9)
        assert r.score < 0 and r.bits_per_byte < 8
    out = [r for r in got if r.held_out]
    assert out and sum(r.bits_per_byte for r in out) / len(out) < 4  # of 8: what was learnt holds for unseen texts


def test_lm_code_length_is_a_distribution():
    code = lm.Code(np.arange(1 << 16) % 977)
    tables = [np.random.default_rng(0).integers(-40, 40, 1 << 12).astype(np.int8) for _ in range(3)]
    bits = (12, 12, 12)
    total = sum(math.exp(-x) for x in lm.lengths([bytes([c]) + b"" for c in range(256)], code, tables, bits))
    assert total < 1  # each also codes its end
    longer = lm.lengths([b"", b"abc " * 5000], code, tables, bits)
    assert longer[1] > longer[0] > 0


def test_lm_weights_by_own_gate():
    rng = np.random.default_rng(3)
    s, bit, gate = rng.normal(0, 2, (3, 256, 2)).astype(np.float32), rng.integers(0, 2, (256, 2)).astype(np.uint8), rng.integers(0, 4, (256, 2)).astype(np.uint8)
    got = lm.mixed(s, bit, gate)
    for j in range(2):
        w, refine = np.full((4, 3), lm.FIRST_WEIGHT), np.zeros((4, lm.LEVELS))
        for t in range(0, 256, lm.STEP):
            later = []
            for i in range(t, t + lm.STEP):
                g, sign = gate[i, j], 2 * int(bit[i, j]) - 1
                x = float(np.clip(w[g] @ s[:, i, j], -9, 9))
                level = int(np.clip((x + 8) * 0.5, 0, lm.LEVELS - 1))
                p = 1 / (1 + math.exp(-sign * (x + refine[g, level])))
                assert math.isclose(got[i, j], -math.log(p), rel_tol=1e-3, abs_tol=1e-4)
                later.append((g, level, sign * (1 - p), s[:, i, j]))
            for g, level, err, x in later:
                w[g] += lm.RATE * err * x
                refine[g, level] += lm.REFINE * err


def test_lm_tables_grow_with_the_corpus():
    assert [lm.table_bits(1 << k)[2] - lm.table_bits(1 << k - 1)[2] for k in range(20, 50)] == [1] * 30
    code = lm.Code(np.arange(1 << 16) % 977)
    for bits in ((30, 31, 32), (33, 34, 35)):
        count, bit, slots, _ = lm.decisions([b"some words of a text " * 50], code, bits)
        for b, s in zip(bits, slots):
            assert int(s.max()) >> b == 0 and int(s.max()) >> b - 3
            tally = lm.Tally(b)
            tally.add(s, bit)
            tally.close()
            tally.add(s[:100], bit[:100])
            tally.add(s[:7] ^ s.dtype.type(1), None)
            at, zeros, ones = tally.table()
            want = Counter(s.tolist()) + Counter(s[:100].tolist())
            assert {x: z + o for x, z, o in zip(at.tolist(), zeros.tolist(), ones.tolist()) if z + o} == want
            values = (at % at.dtype.type(200)).astype(np.uint8)
            assert (lm.Sparse(at, values, s.dtype.type)[s] == s % s.dtype.type(200)).all()
            with pytest.raises(ValueError):
                lm.Sparse(at, values, s.dtype.type)[np.setdiff1d(s ^ s.dtype.type(2), at)]


def test_lm_replies_are_one_cell_each():
    """A slot, its mark and its value lie in one cell of 32 bits (op7_lm: one place is read for a slot, not three); slots that share a cell are found too."""
    slots = np.unique(np.concatenate((np.random.default_rng(2).integers(0, 1 << 30, 3000), np.arange(40) << 14 | 5, [0])))
    values = (slots % 251 - 125).astype(np.int8)
    table = lm.Sparse(slots, values, np.uint32)
    assert table.cells.dtype == np.uint32 and len(table.rest)
    order = np.random.default_rng(3).permutation(len(slots))
    assert (table[slots[order].astype(np.uint32)] == values[order]).all()
    with pytest.raises(ValueError):
        table[np.array([slots[-1] + 1], np.uint32)]


def test_lm_bits_against_whole_tables(spark, rows):
    rows = [(i * 1000 + d, t) for i, (d, t) in enumerate(rows)]
    raw = {d: t.encode().lower() for d, t in rows}
    pairs = np.zeros(1 << 16, np.int64)
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    joined = np.frombuffer(b"".join(b"\0" + t for d, t in raw.items() if not lm.held_out(d)) + b"\0", np.uint8).astype(np.int64)
    np.add.at(pairs, joined[:-1] << 8 | joined[1:], 1)
    code, bits = lm.Code(pairs), lm.table_bits(len(joined))
    counts = [np.zeros((2, 1 << b), np.int64) for b in bits]
    for d, t in raw.items():
        if not lm.held_out(d):
            _, bit, slots, _ = lm.decisions([t], code, bits)
            for c, s in zip(counts, slots):
                np.add.at(c, (bit, s), 1)
    want = lm.lengths(list(raw.values()), code, [lm.odds(*c) for c in counts], bits)
    assert all(math.isclose(got[d], -w / math.log(10), rel_tol=1e-4) for d, w in zip(raw, want))


def test_lm_learns_nothing_from_held_out_texts(spark, rows):
    rows = rows[:60]
    assert any(lm.held_out(d) for d, _ in rows)
    scores = lambda made: {r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.score(spark.createDataFrame(made, "doc_id long, text string").coalesce(1)).collect()}
    one, two = scores(rows), scores([(d, "zq xj " * 3000 if lm.held_out(d) else t) for d, t in rows])
    for d, _ in rows:
        if not lm.held_out(d):
            assert math.isclose(one[d][0], two[d][0], rel_tol=1e-6) and one[d][1:] == two[d][1:]


def test_lm_symbols_by_number_as_one_by_one():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab c\n") for _ in range(rng.randint(0, 300))).encode() for _ in range(40)]
    code, bits = lm.Code(np.arange(1 << 16) % 977), (20, 21, 22)
    tables = [np.random.default_rng(i).integers(-99, 99, 1 << b).astype(np.int8) for i, b in enumerate(bits)]
    count, bit, slots, gate = lm.decisions(texts, code, bits)
    got = lm.looked_up(texts, code, tables, bits)
    assert (got[0] == count).all() and (got[1] == bit).all() and (got[3] == gate).all()
    assert all((x == t[s]).all() for x, t, s in zip(got[2], tables, slots))
    keys = np.random.default_rng(1).integers(0, 500, 5000).astype(np.uint64)
    number, first = lm.numbered(keys)
    assert (keys[first][number] == keys).all() and len(first) == len(np.unique(keys))


def test_lm_awkward_rows(spark):
    got = lm.score(docs_of(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and {r.n_tokens for r in got if r.doc_id in (900, 901, 902)} == {1}
    assert lm.score(docs_of(spark, [])).collect() == []


def test_quality_counts_against_brute_force(rows):
    for _, t in rows:
        b = t.encode()
        words = b.split()
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = set()
        for i, g in enumerate(zip(words, words[1:], words[2:])):
            if grams[g] > 1:
                covered |= {i, i + 1, i + 2}
        ls = t.split("\n")
        dup = sum(1 for i, line in enumerate(ls) if line.encode().split() and line in ls[:i])
        assert quality.counts(b) == (len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered))


def test_viterbi_against_all_paths():
    import itertools

    rng = random.Random(4)
    for _ in range(50):
        e = [rng.uniform(-2, 2) for _ in range(6)]
        t = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
        value = lambda p: sum(x for x, y in zip(e, p) if y) + sum(t[a][b] for a, b in zip(p, p[1:]))
        assert math.isclose(value(quality.viterbi(e, t)), max(map(value, itertools.product((0, 1), repeat=6))))
    assert quality.viterbi([], [[0, 0], [0, 0]]) == []


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fitted = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.judge(docs, fitted).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r.kept for r in got if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in got if r.quality == 0]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.35 * len(junk)


def test_quality_fits_on_all_lines(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda docs: seen.extend(docs) or quality.DEFAULT)
    quality.fit(docs_of(spark, [(1, "some words\n" * 700, "en", "s")]), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert [len(x) for x, _ in seen] == [700]


def test_quality_awkward_rows(spark):
    df = docs_of(spark, AWKWARD).selectExpr("*", "'x' as kept")
    got = quality.judge(df, quality.DEFAULT, keep_columns=True).collect()
    assert len(got) == len(AWKWARD) and not any(r.kept for r in got if r.doc_id in (900, 901, 902))


def test_words_encode_as_the_library(rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), tokens.WordEncoder(path)
    rng = random.Random(1)
    texts = [t for _, t in rows] + ["".join(rng.choice("aAB'sS.,!é́—1٣ \n\t<|endoftext|>Σ\x00\x85\xa0") for _ in range(40)) for _ in range(3000)]
    got = own([t.encode() for t in texts])
    assert got == [np.array(e.ids, "<u2").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip_and_show_damage():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.geometric(0.001, 70_001), 49_000).astype(np.uint16)
    table = tokens.Table(tokens.quantised(np.bincount(ids, minlength=1 << 16)))
    data = tokens.write_file(np.array([3, 4]), np.array([1, 70_000]), ids, 17, table)
    first, doc_ids, counts, back = tokens.read_file(data, table)
    assert first == 17 and doc_ids.tolist() == [3, 4] and counts.tolist() == [1, 70_000] and (back == ids).all()
    assert len(data) < 1.5 * len(ids) * 1.5
    with pytest.raises(ValueError):
        tokens.read_file(data[:-2] + bytes([data[-2] ^ 1, data[-1]]), table)
    assert len(tokens.read_file(tokens.write_file(np.zeros(0, int), np.zeros(0, int), ids[:0], 0, table), table)[3]) == 0


def test_token_files_of_documents(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    files, table = tokens.encode(docs_of(spark, AWKWARD), path, Scratch(spark, "t"), per_shard=4_000)
    got = tokens.decode(files, table.freq).orderBy("start").collect()
    own = tokens.WordEncoder(path)
    want = sorted(((-1 if d is None else d), np.append(np.frombuffer(own([(t or "").encode()])[0], "<u2"), 2).astype("<u4").tobytes()) for d, t, *_ in AWKWARD)
    assert [((-1 if r.doc_id is None else r.doc_id), bytes(r.ids)) for r in got] == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


@pytest.mark.parametrize("n, num", [(4, 85), (2, 60)])
def test_jaccard_against_brute_force(spark, n, num):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    made = []
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 80))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            made.append((len(made), " ".join(w)))
    made += [(1001, ""), (1002, None), (1003, "a b"), (1004, "A  b"), (None, made[0][1])]
    sets = [(d, shingle_set(t, n)) for d, t in made]
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    own = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            shared = len(x & y)
            if 100 * shared >= num * (len(x) + len(y) - shared):
                r, s = root(a), root(b)
                up[max(r, s)] = min(r, s)
    got = jaccard.join(spark.createDataFrame(made, "doc_id long, text string").repartition(4), n, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(s), None if d is None else root(d)) for d, s in sets}


def test_partenum_shares_a_signature():
    rng = np.random.default_rng(9)
    enum = jaccard.PartEnum(80, 100)
    for size in (1, 2, 5, 9, 40, 333):
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 60, size, dtype=np.uint64))
            keep = x[rng.random(len(x)) > 0.1]
            y = np.unique(np.concatenate((keep, rng.integers(0, 1 << 60, rng.integers(0, 1 + size // 10), dtype=np.uint64))))
            shared = len(np.intersect1d(x, y))
            if len(y) and 100 * shared >= 80 * (len(x) + len(y) - shared):
                assert set(enum(x).tolist()) & set(enum(y).tolist())


def test_clashing_columns(spark):
    rows = [(i, "the same line of some length here\nother %d" % i, "s", "kept", i + 100, i + 200) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, gone string, text_hash long, nth long")
    out = {r.doc_id: r for r in lines.dedup(docs, short=True).collect()}
    assert all(r.gone == "kept" and r.n_lines == 2 for r in out.values()) and sum(r.n_removed for r in out.values()) >= 5
    mixed = mixing.stream(docs.withColumnRenamed("gone", "text_hash_").withColumnRenamed("nth", "nth_")).collect()
    assert mixed and all((r.text_hash_, r.text_hash, r.nth_) == ("kept", r.doc_id + 100, r.doc_id + 200) for r in mixed)
    assert all((r.text_hash, r.nth) == (r.doc_id + 100, r.doc_id + 200) for r in mixing.stream(docs).collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "c")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, sizes = Scratch(spark, "p"), [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        before = docs
        docs = scratch.stage(stage(spark, docs, SF), str(k))
        sizes.append(docs.count())
        if k < len(cp.STAGES) - 1:
            assert docs.columns == before.columns
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2] and docs.where("not restored").count() == 0


def test_lm_slots_of_a_range_against_plain_sums():
    rng, size = np.random.default_rng(5), 1 << 17
    sent = []
    for n in (1, 7, 900, 40_000):
        at = np.sort(rng.choice(size, n, replace=False))
        sent.append((at, rng.integers(0, 1 << 20, n), rng.integers(0, 1 << 20, n)))
    zeros, ones = np.zeros((2, size), np.int64)
    for at, x, y in sent:
        zeros[at] += x
        ones[at] += y
    got = lm.summed_slots([lm._shut(at, x.astype("<u4"), y.astype("<u4")) for at, x, y in sent], size)
    for (at, _, _), reply in zip(sent, got, strict=True):
        slots, values = lm._open(reply, "i1")
        assert (slots == at).all() and (values == lm.odds(zeros[at], ones[at])).all()


def test_lm_documents_longer_than_a_chunk(spark, rows, monkeypatch):
    made = [(d, t) for d, t, *_ in rows[:60]] + [(10**6, "long words of a text " * 2000), (10**6 + 1, None)]
    scores = lambda: sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(docs_of(spark, [(*r, "en", "s") for r in made])).collect())
    whole = scores()
    monkeypatch.setattr(lm, "CHUNK", 5000)
    assert scores() == whole and len(whole) == len(made)


def test_lm_like_pieces_are_held_once():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc\0 \né") + "z" * rng.choice((0, 0, 3, 15, 16, 40)) for _ in range(rng.randint(0, 90))).encode() for _ in range(30)]
    pieces, base = lm.Pieces(texts), 0x2545F4914F6CDD1D
    x = lm.Symbols(pieces.joined, *(c[pieces.piece] for c in (pieces.word, pieces.begin, pieces.size)))
    want = []
    for text in texts:
        whole, start = b"\0" * 4 + text + b"\0", 4
        for i in range(4, len(whole)):
            if i > 4 and whole[i - 1] in b"\t\n\v\f\r \0":
                start = i
            two, four = (int.from_bytes(whole[i - k : i], "big") for k in (2, 4))
            word = sum((c + 1) * pow(base, k, 1 << 64) for k, c in enumerate(whole[start:i])) % (1 << 64)
            want.append((whole[i - 1] << 8 | whole[i], sum(i - start >= k for k in (1, 3, 6)), two, four, word))
    assert list(zip(x.symbol.tolist(), x.gate.tolist(), *(c.tolist() for c in x.contexts))) == want
    code, tables = lm.Code(np.arange(1 << 16) % 977), [np.zeros(1 << 12, np.int8)] * 3
    records = lm.Records([b"some words come again "] * 500, code, tables, (12, 12, 12))
    count, found = records[0:500]
    assert count.sum() == len(found) > 400 * len(records.flat)
    cost = lm.costs([found[:4000], found[:4000], found[:70]])
    assert cost[0] == cost[1] and cost[2] == lm.costs([found[:70]])[0]


def test_line_signatures_by_cached_blocks(monkeypatch):
    rng = random.Random(6)
    some = ["".join(rng.choice("ab cdñ") for _ in range(rng.choice((5, 6, 9, 40, 300)))).encode() for _ in range(60)]
    want = np.concatenate([lines.signatures([x]) for x in some])
    for block in (7, 100, 1 << 14):
        monkeypatch.setattr(lines, "CACHED", block)
        assert (lines.signatures(some) == want).all()
