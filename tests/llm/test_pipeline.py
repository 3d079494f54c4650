"""Each stage of the pipeline against brute force on its own input, all stages in turn."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402

from quern.llm import quality  # noqa: E402
from quern.llm.common import Scratch  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of few lines each, with near copies, repeated and alike lines, junk, nulls, repeated rows."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    rows, labels = [], []
    shared = line(14)
    for i in range(60):
        rows.append((i, "\n".join(line(rng.randint(9, 20)) for _ in range(rng.randint(4, 8))), "en", f"s{i % 4}"))
        labels.append((i, 1))
    for i in range(60, 75):  # near copies, of other lines than their model's; then a line that many share, once changed in a letter
        w = rows[i - 60][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, "\n".join(" ".join(w[k : k + 23]) for k in range(0, len(w), 23)), "en", f"s{i % 3}"))
    for i in range(75, 90):
        rows.append((i, rows[i - 30][1] + "\n" + (shared if i % 2 else shared[:20] + "x" + shared[21:]), "de", "s1"))
    for i in range(90, 110):
        rows.append((i, "\n".join("### $$ BUY!! 100% | " * rng.randint(3, 6) + word().upper() * 3 for _ in range(6)), "en", "s2"))
        labels.append((i, 0))
    rows += [(110, None, "en", "s0"), (111, "", "en", None), (112, "same words " * 60, "en", None), (113, "too short", "en", "s9"), (3, rows[3][1], "en", "s3"), (None, line(60), "en", "s0")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def pairs(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def quality_by_hand(spark, rows, docs, path):
    w, t = quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    out = []
    for r in rows:
        text = r["text"] or ""
        words = WORD.findall(text)
        grams = Counter(zip(words, words[1:], words[2:]))
        repeated = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
            continue
        x, sizes = quality.features(text.encode())
        e = x @ w
        value = lambda p: sum(s for s, y in zip(e, p) if y) + sum(t[a][b] for a, b in zip(p, p[1:]))
        best = max(itertools.product((0, 1), repeat=len(e)), key=value)
        if sum(n for n, y in zip(sizes, best) if y) / sum(sizes) >= 0.5:
            out.append(r)
    return out


def united(items, alike):
    up = {i: i for i in items}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(items, 2):
        if alike(a, b):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: root(i) for i in items}


def lines_by_hand(rows):
    first = {}
    for r in rows:
        if r["doc_id"] is not None:
            for i, line in enumerate(r["text"].split("\n")):
                if line.strip():
                    first[line.strip()] = min(first.get(line.strip(), (math.inf, 0)), (r["doc_id"], i))
    grams = {x: {x[i : i + 5] for i in range(len(x) - 4)} for x in first}
    group = united(sorted(first), lambda a, b: bool(grams[a]) and bool(grams[b]) and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]))
    best = {}
    for line, g in group.items():
        best[g] = min(best.get(g, (math.inf, 0)), first[line])
    out = []
    for r in rows:
        own = r["text"].split("\n")
        if r["doc_id"] is not None:
            own = [x for i, x in enumerate(own) if not x.strip() or best[group[x.strip()]] == (r["doc_id"], i)]
        if len(own) == len(r["text"].split("\n")) or WORD.search("\n".join(own)):
            out.append(r.asDict() | {"text": "\n".join(own)})
    return out


def near_by_hand(rows):
    sets = {}
    for r in rows:
        w = WORD.findall(r["text"].lower())
        if r["doc_id"] is not None:
            sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = united(sorted(sets), lambda a, b: bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    return [r for r in rows if r["doc_id"] is None or group[r["doc_id"]] == r["doc_id"]]


def mixture_by_hand(rows):
    size = lambda r: len(WORD.findall(r["text"] or ""))
    key = lambda r: hashlib.md5(f"mix:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(map(size, by[s])) for s in names}
    budget = math.floor(sum(total.values()) * 1.5)
    left, open_, target = budget, list(names), {}
    while True:
        wide = sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * total[s] * wide <= left * weight[s]]
        if not full:
            target |= {s: left * weight[s] / wide for s in open_}
            break
        for s in full:
            target[s] = float(2 * total[s])
            open_.remove(s)
        left -= sum(2 * total[s] for s in full)
        if not open_:
            break
    packets = []
    for s in names:
        start = 0
        for r in sorted(by[s], key=lambda r: (key(r), -1 if r["doc_id"] is None else r["doc_id"])):
            for e in (0, 1):
                for q in range(0, size(r), 100):
                    to = min(size(r), q + 100)
                    packets.append(((e * total[s] + start + to) / target[s], key(r), start, e, q, to - q, r, e))
            start += size(r)
    packets.sort(key=lambda p: p[:5])
    taken, used = Counter(), 0
    for p in packets:
        got = min(max(budget - used, 0), p[5])
        used += p[5]
        taken[id(p[6]), p[7]] += got
    return [r for r in rows for e in (0, 1) if taken[id(r), e] and 2 * taken[id(r), e] >= size(r)]


def test_every_stage_against_brute_force(spark, folder):
    import sentencepiece

    scratch, docs, sizes = Scratch(spark, "p"), spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        rows = docs.collect()
        out = scratch.stage(stage(spark, docs, folder), str(k))
        got = out.collect()
        sizes.append((len(rows), len(got)))
        if k == 4:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == sorted((r["doc_id"] or -1, sp.encode(r["text"] or "")) for r in rows) and all(r["restored"] for r in got)
            break
        assert out.columns == docs.columns
        want = quality_by_hand(spark, rows, docs, folder) if k == 0 else (lines_by_hand, near_by_hand, mixture_by_hand)[k - 1](rows)
        assert pairs(got) == pairs(want), k
        docs = out
    assert sizes[0][1] < sizes[0][0] and sizes[2][1] < sizes[2][0] and sizes[3][1] > sizes[3][0], sizes


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, folder).count() == 0
