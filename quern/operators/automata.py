"""Two small automata over tokens, used inside tasks: one of many terms over a text, one of a passage against many texts."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Sequence

TOKEN = re.compile(r"[^\W_]+|[\W_]")


class Terms:
    """Aho-Corasick over tokens (runs of letters and digits, and each other character): terms as whole words, any case, leftmost first and of those the longest."""

    def __init__(self, terms: Sequence[str]):
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.depth = [0]
        for term in terms:
            node = 0
            for token in TOKEN.findall(term.lower()):
                if token not in self.next[node]:
                    self.next[node][token] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = self.next[node][token]
            if node:
                self.term[node] = term
        self.fail, self.shorter = [0] * len(self.next), [0] * len(self.next)  # longest suffix that is a path; longest one that is a term
        todo = deque(self.next[0].values())
        while todo:
            node = todo.popleft()
            for token, child in self.next[node].items():
                back = self.fail[node]
                while back and token not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(token, 0) if node else 0
                self.shorter[child] = self.fail[child] if self.term[self.fail[child]] is not None else self.shorter[self.fail[child]]
                todo.append(child)

    def find(self, text: str) -> list[str]:
        """Terms in order of their places; places don't overlap. A place ends a run of letters and digits on both sides."""
        tokens = TOKEN.findall(text.lower())
        out: list[str] = []
        waiting: list[tuple[int, int, str]] = []  # places that a longer one or one further left may still take
        node = free = 0
        wordy = lambda i: 0 <= i < len(tokens) and tokens[i].isalnum()
        for i, token in enumerate(tokens):
            while node and token not in self.next[node]:
                node = self.fail[node]
            node = self.next[node].get(token, 0)
            end = node if self.term[node] is not None else self.shorter[node]
            while end:
                start = i - self.depth[end] + 1
                if start >= free and not wordy(start - 1) and not wordy(i + 1):
                    waiting.append((start, -i, self.term[end]))
                end = self.shorter[end]
            if waiting:
                free = self._settle(waiting, out, i - self.depth[node] + 1, free)
        self._settle(waiting, out, len(tokens) + 1, free)
        return out

    @staticmethod
    def _settle(waiting: list, out: list[str], open_from: int, free: int) -> int:
        """Takes the places that no match still open, all of which begin at open_from or later, can take; gives the first token that is free."""
        while waiting and (best := min(waiting))[0] < open_from:
            out.append(best[2])
            free = 1 - best[1]
            waiting[:] = [w for w in waiting if w[0] >= free]
        return free


class Passage:
    """The suffix automaton of a sequence: the longest stretch of it that ends at each token of another, in time linear in both."""

    def __init__(self, words: Sequence[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]  # first: where the state's strings end first
        last = 0
        for i, w in enumerate(words):
            node = self._add({}, self.length[last] + 1, i)
            at = last
            while at >= 0 and w not in self.next[at]:
                self.next[at][w] = node
                at = self.link[at]
            if at < 0:
                self.link[node] = 0
            else:
                to = self.next[at][w]
                if self.length[to] == self.length[at] + 1:
                    self.link[node] = to
                else:
                    copy = self._add(dict(self.next[to]), self.length[at] + 1, self.first[to])
                    self.link[copy] = self.link[to]
                    while at >= 0 and self.next[at].get(w) == to:
                        self.next[at][w] = copy
                        at = self.link[at]
                    self.link[to] = self.link[node] = copy
            last = node

    def _add(self, edges: dict[str, int], length: int, first: int) -> int:
        self.next.append(edges)
        self.link.append(-1)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def longest(self, text: Sequence[str], lo: int, hi: int) -> tuple[int, int, int]:
        """(place in the passage, place in the text, size) of the longest common stretch of text[lo:hi]: of equals the first in the passage, then in the text."""
        node = size = 0
        best = (0, 0, 0)
        for j in range(lo, hi):
            w = text[j]
            while node and w not in self.next[node]:
                node = self.link[node]
                size = self.length[node]
            if w in self.next[node]:
                node, size = self.next[node][w], size + 1
            if size and (size > best[2] or (size == best[2] and self.first[node] - size + 1 < best[0])):
                best = (self.first[node] - size + 1, j - size + 1, size)
        return best


def matching_blocks(passage: Sequence[str], text: Sequence[str], whole: Passage | None = None) -> list[tuple[int, int, int]]:
    """(place in the passage, place in the text, size): the longest block, then the longest on either side of it, and so on; neighbours are one block.

    whole: the passage's automaton, which serves many texts.
    """
    found: list[tuple[int, int, int]] = []
    todo = [(0, len(passage), 0, len(text))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        automaton = whole if whole and (alo, ahi) == (0, len(passage)) else Passage(passage[alo:ahi])
        i, j, k = automaton.longest(text, blo, bhi)
        if k:
            found.append((alo + i, j, k))
            todo += [(alo, alo + i, blo, j), (alo + i + k, ahi, j + k, bhi)]
    out: list[tuple[int, int, int]] = []
    for i, j, k in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + k)
        else:
            out.append((i, j, k))
    return out
