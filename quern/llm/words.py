"""Words of many texts at once: places by numpy, numbers of distinct words by an exact hash table.

A word is a run of bytes that are not ASCII white space. Its first 15 bytes and its length fill two 64-bit numbers, so for words of up to
15 bytes equal numbers mean equal words; longer words are looked up one by one.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import xxhash

from quern.llm.common import mix64

LONG = 15
AT_ONCE = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
MARKS = b".,;:!?"
_KIND = np.full(256, 3, np.uint8)  # 0: space, 1: letter, 2: mark
_KIND[_SPACE], _KIND[97:123], _KIND[list(MARKS)] = 0, 1, 2
_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(17)], np.uint64)


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes that begin and end with a space."""
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    return edge[::2], edge[1::2]


def parts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``spans``, but words are also cut before a mark of ``MARKS`` that follows a letter a-z."""
    kind = _KIND[raw]
    cut = (kind[1:] == 2) & (kind[:-1] == 1)
    space = kind == 0
    edge = space[1:] != space[:-1]
    starts = np.flatnonzero((edge & ~space[1:]) | cut) + 1
    ends = np.flatnonzero((edge & space[1:]) | cut) + 1
    return starts, ends


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, a place of each number), equal keys having one number; by open addressing, all keys at once."""
    n = len(keys)
    size = 1 << max(10, n.bit_length())
    at = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - size.bit_length())).view(np.int64)
    slot, every = np.full(size, -1, np.int32), np.arange(n, dtype=np.int32)
    slot[at] = every  # of several at one slot the last stays
    same = slot.take(at)
    todo = np.flatnonzero(keys.take(same) != keys)
    at = at.take(todo)
    while len(todo):
        at = (at + 1) & (size - 1)
        free = np.flatnonzero(slot.take(at) < 0)
        slot[at.take(free)] = todo.take(free)
        got = slot.take(at)
        hit = keys.take(got) == keys.take(todo)
        same[todo[hit]] = got[hit]
        left = np.flatnonzero(~hit)
        todo, at = todo.take(left), at.take(left)
    first = np.flatnonzero(same == every)
    number = np.empty(n, np.int32)
    number[first] = every[: len(first)]
    return number.take(same), first


class Numbers:
    """Numbers 0, 1, ... of distinct words in order of first sight; ``new`` is told each new batch of words. Emptied at ``most`` words."""

    def __init__(self, most: int, new: Callable[[list[bytes]], None], clear: Callable[[], None], start: int = 0):
        self.most, self.new, self.clear = most, new, clear
        self.size = 1 << max(4, 2 * (start or most) - 1).bit_length()
        self.empty()

    def empty(self) -> None:
        self.n, self.long = 0, {}
        self.slot = np.full(self.size, -1, np.int32)
        self.lo, self.hi = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def _find(self, lo: np.ndarray, hi: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Numbers of words, -1 for unknown ones; with own these (distinct, unknown) words get the numbers own."""
        out = np.full(len(lo), -1, np.int32)
        at = (hashes(lo, hi) & np.uint64(self.size - 1)).astype(np.int64)
        todo = np.arange(len(lo))
        while len(todo):
            got = self.slot[at]
            if own is not None:
                free = got < 0
                self.slot[at[free]] = own[todo[free]]  # of several at one slot the last stays
                left = ~(free & (self.slot[at] == own[todo]))
            else:
                hit = (got >= 0) & (self.lo[got] == lo[todo]) & (self.hi[got] == hi[todo])
                out[todo[hit]] = got[hit]
                left = (got >= 0) & ~hit
            todo, at = todo[left], (at[left] + 1) & (self.size - 1)
        return out

    def __call__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word of raw, which goes on for 16 bytes after the last."""
        size = ends - starts
        lo, hi = halves(raw, starts, size)
        out = self._find(lo, hi)
        far = np.flatnonzero(size > LONG)
        if len(far):
            words = [raw[s:e] for s, e in zip(starts[far].tolist(), ends[far].tolist())]
            out[far] = [self.long.get(w, -1) for w in words]
        lost = np.flatnonzero(out < 0)
        if not len(lost):
            return out
        if self.n > self.most:
            self.empty()
            self.clear()
            return self(raw, starts, ends)
        # Distinct new words, short ones first.
        short = lost[size[lost] <= LONG]
        a, b = lo[short], hi[short]
        like, first = numbered(hashes(a, b))
        if (a[first][like] != a).any() or (b[first][like] != b).any():  # others of one hash
            order = np.lexsort((b, a))
            fresh = (np.diff(a[order], prepend=a[order[:1]] + np.uint64(1)) != 0) | (np.diff(b[order], prepend=b[order[:1]]) != 0)
            first = order[fresh]
        first = short[first]
        more = dict.fromkeys(raw[starts[i] : ends[i]] for i in lost[size[lost] > LONG].tolist())
        words = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        n = self.n + len(words) + len(more)
        if n > len(self.lo):
            self.lo, self.hi = (np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), np.uint64))) for x in (self.lo, self.hi))
        if 2 * n > self.size:
            self.size = 1 << (4 * n).bit_length()
            self.slot = np.full(self.size, -1, np.int32)
            keep = np.flatnonzero(self.hi[: self.n] != 0).astype(np.int32)  # long words have none
            self._find(self.lo[keep], self.hi[keep], keep)
        self.lo[self.n : self.n + len(words)], self.hi[self.n : self.n + len(words)] = lo[first], hi[first]
        self._find(lo[first], hi[first], np.arange(self.n, self.n + len(words), dtype=np.int32))
        for i, w in enumerate(more):
            self.long[w] = self.n + len(words) + i
        self.n = n
        self.new(words + list(more))
        out[lost] = self._find(lo[lost], hi[lost])
        for i in lost[size[lost] > LONG].tolist():
            out[i] = self.long[raw[starts[i] : ends[i]]]
        return out


def halves(raw: bytes, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes 0 to 7 of each word, and bytes 8 to 14 with its size."""
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    return eight[starts] & _MASK[np.minimum(size, 8)], eight[starts + 8] & _MASK[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)


def hashes(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix64(lo ^ mix64(hi))


class Vocabulary:
    """The distinct words of a few MB of texts: ``number`` of each word in turn, ``count`` of words of each text."""

    def __init__(self, texts: list[bytes]):
        self.words: list[bytes] = []
        self.numbers = Numbers(1 << 40, self.words.extend, lambda: None, 1 << 17)
        number, count = [], []
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= AT_ONCE):
                size += len(texts[hi])
                hi += 1
            raw = b" " + b" ".join(texts[lo:hi]) + b" " * 17
            starts, ends = spans(np.frombuffer(raw, np.uint8))
            # Like words once; long ones, and others of one hash, each by itself.
            a, b = halves(raw, starts, ends - starts)
            like, first = numbered(hashes(a, b))
            own = np.flatnonzero((a[first][like] != a) | (b[first][like] != b) | (ends - starts > LONG))
            like[own] = len(first) + np.arange(len(own), dtype=np.int32)
            first = np.append(first, own)
            number.append(self.numbers(raw, starts[first], ends[first])[like])
            edge = np.searchsorted(starts, 1 + np.cumsum([len(t) + 1 for t in texts[lo:hi]]))
            count.append(np.diff(np.concatenate(([0], edge))))
            lo = hi
        self.number = np.concatenate(number) if number else np.zeros(0, np.int32)
        self.count = np.concatenate(count) if count else np.zeros(0, np.int64)

    def by_bucket(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """(bucket, numbers of its words); the order depends on the words alone."""
        n, own = len(self.words), self.numbers
        lo, hi = own.lo[:n].copy(), own.hi[:n].copy()
        far = sorted((w, i) for w, i in own.long.items())
        for k, (w, i) in enumerate(far):  # long words: a hash, and their order
            lo[i], hi[i] = xxhash.xxh3_64_intdigest(w), k
        bucket = hashes(lo, np.where(own.hi[:n] == 0, np.uint64(0), hi)) % np.uint64(buckets)
        order = np.lexsort((hi, lo, bucket))
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        return [(int(bucket[x[0]]), x) for x in np.split(order, cut)] if n else []


class Lists:
    """Lists of integers, laid end to end; grows by doubling."""

    def __init__(self, kind: str):
        self.flat, self.start, self.n, self.end = np.zeros(1024, kind), np.zeros(1024, np.int64), 0, 0

    def extend(self, lists: list) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        n, end = self.n + len(lists), self.end + int(sizes.sum())
        if end > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.end], np.zeros(2 * end - self.end, self.flat.dtype)))
        if n >= len(self.start):
            self.start = np.concatenate((self.start[: self.n + 1], np.zeros(2 * n - self.n, np.int64)))
        self.flat[self.end : end] = np.fromiter(itertools.chain.from_iterable(lists), self.flat.dtype, end - self.end)
        self.start[self.n + 1 : n + 1] = self.end + np.cumsum(sizes)
        self.n, self.end = n, end

    def __getitem__(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the lists of these numbers in turn, their sizes)."""
        at = self.start[number]
        size = self.start[number + 1] - at
        return self.flat[ragged(at, size)], size


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start[i], start[i] + 1, ... start[i] + size[i] - 1 in turn."""
    done = np.cumsum(size)
    return np.repeat(start - (done - size), size) + np.arange(int(done[-1]) if len(done) else 0)
