"""Matching statistics and spans of the licence scan against brute force."""

import random

from quern.llm import licences


def matches_by_hand(words, texts, least):
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    length = []
    for end in range(1, len(words) + 1):
        length.append(next((n for n in range(end, 0, -1) if tuple(words[end - n : end]) in runs), 0))
    # A match is right-maximal where one word more makes it no longer.
    return [(i + 1 - n, n) for i, n in enumerate(length) if n >= least and (i + 1 == len(length) or length[i + 1] <= n)]


def test_matches_are_right_maximal():
    rng = random.Random(1)
    templates = tuple((f"l{k}", " ".join(rng.choice("abcdef") for _ in range(rng.randint(4, 14)))) for k in range(6))
    scan = licences.Scanner((("a b", "base"),), templates)
    for _ in range(200):
        words = [rng.choice("abcdefgz").encode() for _ in range(rng.randint(0, 40))]
        got = [(s, n) for s, n, _ in scan.matches(words)[1]]
        assert got == matches_by_hand(words, scan.texts, licences.MIN_MATCH)


def test_whole_licences_are_found_where_they_stand():
    scan, rng = licences.Scanner(), random.Random(2)
    filler = [f"w{i}" for i in range(50)]
    for label, text in licences.LICENCES:
        words = [w.decode() for w in licences.words_of(text.encode())]
        for changed in (0, 3):
            own = list(words)
            for at in rng.sample(range(10, len(own) - 10), changed):
                own[at] = "zzyzx"
            before, after = rng.choices(filler, k=rng.randint(0, 60)), rng.choices(filler, k=20)
            n, _, spans = scan(" ".join(before + own + after).encode())
            best = max((s for s in spans if s[0] == label), key=lambda s: s[2] - s[1])
            assert n == len(before) + len(own) + len(after)
            assert abs(best[1] - len(before)) <= 8 and abs(best[2] - len(before) - len(own)) <= 8 and best[3] >= 0.75
    assert scan(" ".join(filler * 30).encode())[2] == []


def test_parts_of_licences_are_no_spans_and_ties_give_each_label():
    scan = licences.Scanner((), (("one", "a b c d e f g h"), ("two", "a b c d e f g h"), ("three", "a b c d x y z q r s t u v")))
    spans = scan(b"k a b c d e f g h k")[2]
    assert [(s[0], s[1], s[2], s[3]) for s in spans] == [("one", 1, 9, 1.0), ("two", 1, 9, 1.0)]
    gap = "a b c d " + "n " * licences.MAX_GAP + "e f g h"
    assert {s[0] for s in scan(gap.encode())[2]} == {"one", "two"}
    assert scan(("a b c d " + "n " * (licences.MAX_GAP + 1) + "e f g h").encode())[2] == []
