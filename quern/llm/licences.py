"""Operator 1: licence scans by a generalised suffix automaton of licence words.

The automaton holds every run of words of every template. A document is streamed through it once; after
each word it gives the longest run ending there that some template contains (matching statistics).
Matches that no longer match one word further are chained, per template, when they follow each other in
both texts with a small gap; a chain that covers enough of its template is a span with the template's
label. Templates of the base phrases are found at every place: a phrase ends at a word exactly if its
state is the current state or reached from it by suffix links.

Memory is that of the automaton and one document. Cases: null and empty text has no words, labels '' and
score 0; overlapping places all count; repeated rows each give a row; a null doc_id comes back null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import utf8

#: Phrases and labels of the base.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices, the words by which licences are declared, with labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Whole public licences, from the grant to the disclaimer.
LICENCES = (
    ("mit", TEMPLATES[2][1] + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, '
     "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-clause", _BSD + _BSD_END),
    ("bsd-3-clause", _BSD + _BSD_THIRD + _BSD_END),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
     "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
     "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
     "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS),
)
MIN_MATCH, MAX_GAP, MIN_SHARE = 4, 12, 0.6
#: Every byte that ends a word becomes a space; A-Z become a-z.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton over words; ``ends`` of a state: (template, end) places of its runs."""

    def __init__(self, texts: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len, own = [-1], [0], [[]]
        for t, words in enumerate(texts):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w, own)
                own[last].append((t, i + 1))
        self.ends: list[list[tuple[int, int]]] = [list(x) for x in own]
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            self.ends[self.link[s]] += self.ends[s]
        for ends in self.ends:
            ends.sort()  # by template, then place: the first place after a chain's end is the nearest

    def _extend(self, last: int, w: bytes, own: list) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w, own)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        own.append([])
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w, own)
        return cur

    def _split(self, p: int, q: int, w: bytes, own: list) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        own.append([])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy


class Scanner:
    def __init__(self, base: tuple = BASE, templates: tuple = TEMPLATES + LICENCES):
        self.base, self.templates = base, templates
        self.phrases = [words_of(p.encode()) for p, _ in base]
        self.texts = self.phrases + [words_of(t.encode()) for _, t in templates]
        self.labels = [label for _, label in base] + [label for label, _ in templates]
        self.sam = Automaton(self.texts)
        # Phrases whose state is a state or one of its suffix links.
        at = {}
        for k, words in enumerate(self.phrases):
            s = 0
            for w in words:
                s = self.sam.next[s][w]
            at.setdefault(s, []).append(k)
        self.suffix_phrases: list[list[int]] = []
        for s in range(len(self.sam.len)):
            found, x = [], s
            while x > 0:
                found += at.get(x, [])
                x = self.sam.link[x]
            self.suffix_phrases.append(found)
        self.vocabulary = {w for t in self.texts for w in t}

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places of base phrases (phrase, start) and right-maximal matches (start, length, state)."""
        nxt, link, length, phrases, vocabulary = self.sam.next, self.sam.link, self.sam.len, self.suffix_phrases, self.vocabulary
        places, found = [], []
        state = size = 0
        for i, w in enumerate(words):
            if w not in vocabulary:
                if size >= MIN_MATCH:
                    found.append((i - size, size, state))
                state = size = 0
                continue
            before, was = size, state
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if size < before and before >= MIN_MATCH:
                found.append((i - before, before, was))
            if w in nxt[state]:
                state, size = nxt[state][w], size + 1
                for k in phrases[state]:
                    if len(self.phrases[k]) <= size:
                        places.append((k, i + 1 - len(self.phrases[k])))
            else:
                size = 0
        if size >= MIN_MATCH:
            found.append((len(words) - size, size, state))
        return places, found

    def spans(self, words: list[bytes], found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, share of the template) of each chain that covers enough."""
        open_: dict[int, list] = {}
        done: list[tuple[str, int, int, float]] = []

        def close(t: int, c: list) -> None:
            share = c[3] / len(self.texts[t])
            if share >= MIN_SHARE:
                done.append((self.labels[t], c[0], c[1], share))

        for start, size, state in found:
            best: dict[int, int] = {}
            for t, end in self.sam.ends[state]:  # the first place in the template after the chain's end, else the first
                c = open_.get(t)
                ahead = c is not None and end - size >= c[2] - (c[1] - start if start < c[1] else 0)
                if t not in best or (ahead and best[t][1] is False):
                    best[t] = (end, ahead)
            for t, (end, ahead) in best.items():
                if t < len(self.base):
                    continue
                c = open_.get(t)
                if c and ahead and start - c[1] <= MAX_GAP:
                    c[3] += end - max(c[2], end - size)
                    c[1], c[2] = start + size, end
                else:
                    if c:
                        close(t, c)
                    open_[t] = [start, start + size, end, size]
        for t, c in open_.items():
            close(t, c)
        return sorted(done)

    def __call__(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        words = words_of(text)
        places, found = self.matches(words)
        return len(words), places, self.spans(words, found) if found else []


@functools.lru_cache(1)
def _scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of docs (doc_id, text)."""
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for b in batches:
            out = defaultdict(list)
            for text in utf8(b.column("text")):
                n, places, spans = scanner(text)
                own = {scanner.labels[k] for k, _ in places}
                out["n_words"].append(n)
                out["n_base"].append(len(places))
                out["first_word"].append(min((s for _, s in places), default=None))
                out["last_word"].append(max((s for _, s in places), default=None))
                out["base_labels"].append(",".join(sorted(own)))
                out["labels"].append(",".join(sorted(own | {s[0] for s in spans})))
                out["score"].append(1.0 if places else max((s[3] for s in spans), default=0.0))
                out["spans"].append([dict(zip(("label", "first", "end", "share"), s)) for s in spans])
            kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": span}
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(out[c], kinds.get(c, pa.int64())) for c in names)], ["doc_id", *names])

    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: bigint, end: bigint, share: double>>"
    return docs.select("doc_id", "text").mapInArrow(rows, kind)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
