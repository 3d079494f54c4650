"""Language identification, kd-tree clustering and spelling variants against brute force and held-out accuracy, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import kdmeans, language, spelling
from quern.llm.common import Scratch

SF = "/root/testdata/sf0.01"


def grams_by_hand(text):
    squeezed = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
    return sum(max(0, len(squeezed) - n + 1) for n in (1, 2, 3))


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab é  \n.Zß") for _ in range(rng.randint(0, 60)))
        monkeypatch.setattr(language, "CHARS", 1 << 18)
        places, numbers = language.counts(text)
        monkeypatch.setattr(language, "CHARS", rng.choice([1, 2, 3, 5, 7]))
        again = language.counts(text)
        assert (places == again[0]).all() and (numbers == again[1]).all()
        assert numbers.sum() == (grams_by_hand(text) if any(c.isalpha() for c in text) else 0)


def test_elastic_net_keeps_weights_at_zero():
    rng = np.random.default_rng(2)
    rows, label = [], rng.integers(0, 3, 300)
    for y in label:
        at = np.array([int(y), *rng.choice(np.arange(10, 200), 5, replace=False)])
        rows.append((at, np.full(6, 1 / 6**0.5)))
    few, many = (language.fit_leader(rows, label, 3, l1=l1) for l1 in (1.0, 0.0))
    assert (few != 0).sum() < (many != 0).sum() / 2
    assert all(int((v @ few[at] + few[-1]).argmax()) == y for (at, v), y in zip(rows, label))


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    logits = rng.normal(0, 2, (20_000, 3))
    label = np.array([rng.choice(3, p=p) for p in language.softmax(logits)])
    assert abs(language.fit_temperature(logits * 4, label) - 4) < 0.3
    assert language.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return language.fit(documents)


def test_language_held_out_accuracy(documents, model):
    got = {r.doc_id: r for r in language.identify(documents, model).collect()}
    truth = {r.doc_id: r.lang for r in documents.collect()}
    assert set(got) == set(truth)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [r for r in got.values() if r.held_out]
    right = np.array([r.lang_pred == truth[r.doc_id] for r in held])
    assert right.mean() > 0.97
    assert abs(np.mean([r.score for r in held]) - right.mean()) < 0.03  # scores are probabilities
    df, n = language.document_frequencies(language.learnable(documents))
    texts = [r.text for r in documents.collect() if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    assert n == sum(any(c.isalpha() for c in t or "") for t in texts)
    want = np.zeros(language.FEATURES, np.int64)
    for t in texts:
        want[language.counts(t or "")[0]] += 1
    assert (df == want).all()


def test_language_sees_the_text_alone(spark, documents, model):
    rows = [(r.doc_id, r.text) for r in documents.limit(50).collect()]
    swapped = [(d + 1, t, "fr", "s9", 1) for d, t in rows]
    a = [(r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    b = [(r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(swapped, "doc_id long, text string, lang string, source string, lang_pred int"), model).collect()]
    assert a == b


def test_language_awkward_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 - 34\n"), (None, "the and of that"), (4, "x" * 600_000), (5, "same the and"), (5, "same the and")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)] == [(k, "und", 0.0) for k in (1, 2, 3)]
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and next(r for r in got if r.doc_id is None).held_out
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = language.fit(empty)
    assert language.identify(empty, nothing).count() == 0
    assert [r.lang_pred for r in language.identify(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), nothing).collect()] == ["und"]
    one = language.fit(spark.createDataFrame([(k, f"words {k}", "en" if k != 7 else None) for k in range(20)], "doc_id long, text string, lang string"))
    assert one("anything") == ("en", 1.0)


def clusters_by_hand(rows, k, rounds, dims, seed=3):
    own = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    exact = lambda x: int(x * 1024 // 1) if np.isfinite(x * 1024) else int(x) * 1024
    ints = [[exact(float(x)) for x in v] for _, v in own]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), list(v), q) for (i, v), q in zip(own, ints) if i is not None)
    c = [q for _, _, q in order[:k]]
    far = lambda q, m: sum((a - b) ** 2 for a, b in zip(q, m))
    nearest = lambda q: min(range(len(c)), key=lambda j: (far(q, c[j]), j))
    for _ in range(rounds):
        label = [nearest(q) for q in ints]
        for j in range(len(c)):
            mine = [q for q, l in zip(ints, label) if l == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    label = [nearest(q) for q in ints]
    d = [far(q, c[l]) for q, l in zip(ints, label)]
    inertia = [sum(x for x, l in zip(d, label) if l == j) for j in range(len(c))]
    most = (1 << 63) - 1
    return [(i, l, min(x, most), min(inertia[l], most), min(sum(d), most), hashlib.sha256(",".join(map(str, c[l])).encode()).hexdigest()) for (i, _), l, x in zip(own, label, d)]


def plain(rows):
    return sorted(tuple(r) if r[0] is not None else (-1, *r[1:]) for r in rows)


@pytest.mark.parametrize("wide", [False, True])
def test_centroids_by_hand(spark, monkeypatch, wide):
    monkeypatch.setattr(kdmeans, "BLOCK", 64)
    monkeypatch.setattr(kdmeans, "LEAF", 4)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (5, 4))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.1, 4)).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(80)]  # copies, and ties
    rows += [(7, [1.0, 2.0, 3.0, 4.0]), (7, [1.0, 2.0, 3.0, 4.0]), (None, [0.0, 0.0, 0.0, 0.0]), (900, None), (901, [1.0]), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [-0.0, -1e-9, 1e-9, 0.0])]
    if wide:
        rows += [(910, [1e30, -1e30, 1e6, 0.0]), (911, [1.1e30, -1e30, 3e5, 7.0]), (912, [1e308, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    assert plain(kdmeans.cluster(df, k=6, rounds=4, dims=4).collect()) == plain(clusters_by_hand(rows, 6, 4, 4))


def test_centroids_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert kdmeans.cluster(spark.createDataFrame([], schema), dims=2).count() == 0
    assert kdmeans.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema), dims=2).count() == 0
    got = kdmeans.cluster(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema), dims=2).collect()
    assert [r.distance for r in got] == [0, 0] and len({r.cluster for r in got}) == 2


def test_trees_prune_and_assign_whole_nodes():
    rng = np.random.default_rng(6)
    centres = rng.integers(-1000, 1000, (8, 3))
    x = np.concatenate([c + rng.integers(-20, 20, (500, 3)) for c in centres])
    tree = kdmeans.Tree(x)
    whole, single = tree.assign(centres)
    assert sum(int((cuts[:, 1] - cuts[:, 0]).sum()) for _, cuts, _ in whole if len(cuts)) > len(x) * 0.8  # most points are never compared
    want = ((tree.x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (tree.labels(centres) == want).all()
    total = tree.sums(centres)
    assert all((total[k, :-1] == tree.x[want == k].sum(0)).all() and total[k, -1] == (want == k).sum() for k in range(8))


def variants_by_hand(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else -1) for w in n)


def test_spelling_by_hand(spark):
    rng = random.Random(8)
    base = ["aaabbb", "aaabbé", "aaaabbb", "bananas", "banana", "bandana", "cottage", "Pottage", "pottages", "x×y÷zz", "aaaaaa", "aaaaaaa"]
    words = []
    for w in base:
        words += [w] * rng.choice([5, 6, 30, 200, 1200])
        for _ in range(12):
            v = list(w)
            at = rng.randrange(len(v))
            v[at : at + 1] = rng.choice([[], [rng.choice("abté")], [v[at], rng.choice("abté")]])
            words += ["".join(v)] * rng.choice([1, 5, 7, 40])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    rows += [(None, "bananas bananas bananas"), (1, None), (2, ""), (3, "\n 123"), (9, "cottage_cottage-" * 3000), (9, "cottage"), (9, "cottage")]
    got = spelling.variants(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(3)).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got) == variants_by_hand(rows)
    assert any(r.form is not None for r in got)


def test_spelling_chains_and_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    chain = [(f"w{i}", f"w{i + 1}") for i in range(21)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string"), Scratch(spark, "t")).collect()}
    assert got == {f"w{i}": "w21" for i in range(21)}
