"""Operator 7: language-model scores by online logistic context mixing.

A text (A-Z lower-cased, closed by a zero byte) is a sequence of binary decisions: its bytes along Huffman trees of the corpus's
bytes, one tree for each byte before. Three predictors give each decision a probability from counts over all training documents, found by a
hash of the node and a context: the last 2 bytes, the last 4, and the current word so far. A mixer adds their
log odds by weights of a gate (how far into a word), and an adaptive refinement moves the result by what was learnt
at that level of confidence. Weights and refinement start alike in each run of ``RUN`` decisions of a document and are trained
online, after each ``STEP`` decisions; so runs are independent lanes that numpy carries together. The total is a proper code length.

Counts are sums over all training documents: chunks send the counts of their slots by ranges of slots, and of their words by
bucket; what all chunks together have of each comes back to the chunk. The number of slots follows the corpus without a bound, and no table is
sent to every task.

Cases: null and empty text: the end alone (n_tokens 1, bits of the closing zero byte); no training documents: unknown tokens with N = V = 0
give log10(0.1 / 0.1) = 0 and even odds; a null doc_id is held out (the CRC-32 of nothing is 0) and comes back null; repeated rows each count;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chunks, words
from quern.llm.common import Scratch, alone, mix64, release_shuffles, spread
from quern.llm.words import numbered

RUN, STEP, LANES = 4096, 32, 512
SCALE = 12.0  # steps of a log odds of 1 in the tables
RATE, REFINE, FIRST_WEIGHT = 0.02, 0.02, 0.4
GATES, LEVELS = 4, 8
PAD = 4
END = b"\0"
CHUNK = 12 << 20  # bytes of text: the larger, the fewer slots for each byte are exchanged
SHARED = 12 << 20  # bytes of texts whose like pieces are held once
AT_ONCE = 1 << 18  # bytes of pieces whose symbols are numbered at once
RANGES, WIDE = 5, 20  # of a table: 2**5 ranges at least, each of 2**20 slots at most
RAW = 1 << 20  # slots of a chunk that are held before they are counted
PIECE = 1 << 16  # slots of a range whose log odds are taken at once
HEAD, TAIL = 4, 16  # a word is cut after so many bytes
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32, 0]] = True
_GATE = np.array([0, 1, 1, 2, 2, 2, 3], np.uint8)  # by bytes since the last white space


def _paths(counts: list[int]) -> list[list[tuple[int, int]]]:
    """Per byte its way down a Huffman tree: (inner node, bit)."""
    heap = [(c + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children, n = {}, len(counts)
    while len(heap) > 1:
        (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
        children[n] = (a, b)
        heapq.heappush(heap, (x + y, n))
        n += 1
    path: dict[int, list] = {n - 1: []}
    for node in range(n - 1, len(counts) - 1, -1):
        for bit, child in enumerate(children[node]):
            path[child] = [*path[node], (node, bit)]
    return [path[i] for i in range(len(counts))]


class Code:
    """A Huffman code of bytes for each byte before: the decisions (a key of the node, a bit) of every pair, laid end to end."""

    def __init__(self, counts: np.ndarray):
        ways = [p for before in counts.reshape(256, 256).tolist() for p in _paths(before)]
        self.size = np.array([len(p) for p in ways], np.int32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)
        before = np.repeat(np.arange(1 << 16) >> 8, self.size).astype(np.uint64)
        node = np.array([x for p in ways for x, _ in p], np.uint64)
        self.bit = np.array([x for p in ways for _, x in p], np.uint8)
        self.key = (mix64(before << np.uint64(16) | node) >> np.uint64(32)).astype(np.uint32)  # of the node


@functools.lru_cache(1)
def code_of(counts: bytes) -> Code:
    return Code(np.frombuffer(counts, np.int64))


class Symbols:
    """The coded bytes of some pieces, end to end, each with the byte before it: ``symbol`` (16 bits), ``gate``, and its three contexts.

    A piece goes from ``begin`` on for ``size`` bytes of ``joined``, in the word that starts at ``word``; a word ends with its white space.
    Where a context and a symbol come again, so do their decisions and slots: ``numbers`` of a context tells them apart once.
    """

    def __init__(self, joined: bytes, word: np.ndarray, begin: np.ndarray, size: np.ndarray):
        raw = np.frombuffer(joined, np.uint8)
        at = chunks_ragged(begin, size)
        four = np.ndarray((len(joined) - 7,), ">u4", joined, strides=(1,))[at - 4].astype(np.uint32)  # the byte before is the lowest
        into = at - np.repeat(word.astype(np.int32), size)
        self.gate = _GATE[np.minimum(into, 6)]
        self.symbol = (four & np.uint32(255)).astype(np.int32) << 8 | raw[at]
        # The word so far: a polynomial over its bytes, from the word's start.
        whole = begin - word + size
        every = raw[chunks_ragged(word, whole)].astype(np.uint64)
        power, inverse = chunks_powers(len(every))
        total = np.zeros(len(every) + 1, np.uint64)
        every += np.uint64(1)
        every *= power[: len(every)]
        np.cumsum(every, out=total[1:])
        first = np.cumsum(whole) - whole
        so_far = (total[chunks_ragged(first + begin - word, size)] - np.repeat(total[first], size)) * np.repeat(inverse[first], size)
        self.contexts = [(four & np.uint32(0xFFFF)).astype(np.uint64), four.astype(np.uint64), so_far]

    def numbers(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of each place's context t and symbol, one place of each number)."""
        c = self.contexts[t]
        if t == 0:  # 24 bits: the byte before that is shared by context and symbol
            return numbered_small((c >> np.uint64(8) << np.uint64(16)).astype(np.int32) | self.symbol)
        return numbered((c << np.uint64(16) if t < 2 else mix64(c)) ^ self.symbol.astype(np.uint64))

    def slots(self, t: int, at: np.ndarray | slice, code: Code, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the symbols at some places: places of their decisions in the code, and slots of context t."""
        symbol = self.symbol[at]
        per = code.size[symbol]
        nth = chunks_ragged(code.start[symbol], per)
        node = code.key[nth]
        h = self.contexts[t][at] * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        if bits > 32:
            return nth, mix64(np.repeat(h, per) ^ node) & np.uint64((1 << bits) - 1)
        h = np.repeat((h >> np.uint64(32)).astype(np.uint32), per)
        h ^= node
        h &= np.uint32((1 << bits) - 1)
        return nth, h


def chunks_ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start[i], ... start[i] + size[i] - 1 in turn."""
    done = np.cumsum(size)
    return np.repeat((start - (done - size)).astype(np.int32), size) + np.arange(int(done[-1]) if len(done) else 0, dtype=np.int32)


_PLACES: list[np.ndarray] = []


def numbered_small(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``numbered``, of keys under 2**24, by a table of that size."""
    if not _PLACES:
        _PLACES.append(np.zeros(1 << 24, np.int32))
    table = _PLACES[0]
    table[keys] = np.arange(len(keys), dtype=np.int32)
    same = table[keys]
    first = np.flatnonzero(same == np.arange(len(keys), dtype=np.int32))
    table[keys[first]] = np.arange(len(first), dtype=np.int32)
    return table[keys], first


class Pieces:
    """Words of texts cut after 4 and 16 bytes, and which of these pieces are alike: all their contexts and symbols are the same.

    ``piece`` is the number of each piece in turn, ``count`` how many a text has. Equal first pieces agree in the 4 bytes before them too, equal
    second ones in the whole word so far. What goes beyond 16 bytes of a word is a piece of its own.
    """

    def __init__(self, texts: list[bytes]):
        self.joined = b"".join([b"\0" * PAD + t + END for t in texts]) + b"\0" * TAIL
        raw = np.frombuffer(self.joined, np.uint8)
        self.sizes = np.array([len(t) + 1 for t in texts])
        begin = np.cumsum(self.sizes + PAD) - self.sizes
        close = begin + self.sizes  # after the zero byte
        before = _SPACE[raw]
        for i in range(1, PAD):
            before[begin - 1 - i] = False
        before[close - 1] = False
        before[close[-1] :] = False
        word = np.flatnonzero(before) + 1
        self.place = np.searchsorted(word, begin)  # of each text's first word
        end = np.append(word[1:], close[-1])
        end[np.append(self.place[1:], len(word)) - 1] = close
        n = end - word
        eight = np.ndarray((len(raw) - 7,), "<u8", self.joined, strides=(1,))
        key = eight[word - 4] & words._MASK[np.minimum(n, HEAD) + 4]
        heads, head = numbered(key)
        long, far = np.flatnonzero(n > HEAD), np.flatnonzero(n > TAIL)
        lo, hi = eight[word[long]], eight[word[long] + 8] & words._MASK[np.clip(n[long] - 8, 0, 8)]
        lo &= words._MASK[np.minimum(n[long], 8)]
        tails, tail = numbered(words.hashes(lo, hi))
        odd = np.flatnonzero((lo[tail][tails] != lo) | (hi[tail][tails] != hi))  # other words of one hash
        tails[odd] = len(tail) + np.arange(len(odd), dtype=np.int32)
        tail = long[np.append(tail, odd)]
        # First pieces, then second ones, then the rest.
        self.word = np.concatenate((word[head], word[tail], word[far]))
        self.begin = self.word + np.repeat([0, HEAD, TAIL], [len(head), len(tail), len(far)])
        self.size = np.concatenate((np.minimum(n[head], HEAD), np.minimum(n[tail], TAIL) - HEAD, n[far] - TAIL))
        per = 1 + (n > HEAD) + (n > TAIL)
        at = np.cumsum(per) - per
        self.piece = np.empty(int(per.sum()), np.int32)
        self.piece[at] = heads
        self.piece[at[long] + 1] = tails + np.int32(len(head))
        self.piece[at[far] + 2] = np.arange(len(far), dtype=np.int32) + np.int32(len(head) + len(tail))
        self.count = np.add.reduceat(per, self.place)

    def blocks(self) -> Iterator[tuple[slice, Symbols]]:
        """The distinct pieces in turn, some at once."""
        done, lo = np.cumsum(self.size), 0
        while lo < len(done):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + AT_ONCE, "right")))
            yield slice(lo, hi), Symbols(self.joined, self.word[lo:hi], self.begin[lo:hi], self.size[lo:hi])
            lo = hi


class Records:
    """All decisions of texts: three log odds, and bit and gate, of each in one number of 32 bits, those of like pieces held once."""

    def __init__(self, texts: list[bytes], code: Code, tables: list, bits: tuple[int, int, int]):
        self.pieces = Pieces(texts)
        flat, sizes = [], []
        for own, x in self.pieces.blocks():
            per = code.size[x.symbol]
            done = np.cumsum(per)
            owner = np.repeat(np.arange(len(per), dtype=np.int32), per)
            within = np.arange(len(owner), dtype=np.int32) - (done - per).astype(np.int32).take(owner)
            out = np.empty((len(owner), 4), np.int8)
            for t, b in enumerate(bits):
                number, first = x.numbers(t)
                values = tables[t][x.slots(t, first, code, b)[1]]
                size = code.size[x.symbol[first]]
                at = (np.cumsum(size) - size).astype(np.int32)[number].take(owner)
                at += within
                out[:, t] = values.take(at)
            at = code.start[x.symbol].take(owner)
            at += within
            out[:, 3] = code.bit.take(at) | (x.gate << 1).take(owner)
            flat.append(out.view("<u4").ravel())
            size = self.pieces.size[own]
            sizes.append(np.add.reduceat(per, np.cumsum(size) - size))
        self.flat = np.concatenate(flat)
        self.size = np.concatenate(sizes)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32 if len(self.flat) < 1 << 31 else np.int64)
        self.edge = np.concatenate(([0], np.cumsum(self.pieces.count)))  # of each text's pieces

    def __getitem__(self, texts: slice) -> tuple[np.ndarray, np.ndarray]:
        """(number of decisions of each text, all their decisions)."""
        edge = self.edge[texts.start : texts.stop + 1]
        own = self.pieces.piece[edge[0] : edge[-1]]
        size = self.size[own]
        return np.add.reduceat(size, edge[:-1] - edge[0]), self.flat.take(chunks_ragged(self.start[own], size))


def decisions(texts: list[bytes], code: Code, bits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of texts in turn: number of decisions of each, the bits, the slots in each table, the gates."""
    p = Pieces(texts)
    x = Symbols(p.joined, p.word[p.piece], p.begin[p.piece], p.size[p.piece])
    per = code.size[x.symbol]
    found = [x.slots(t, slice(None), code, b) for t, b in enumerate(bits)]
    count = np.diff(np.concatenate(([0], np.cumsum(per)[np.cumsum(p.sizes) - 1])))
    return count, code.bit[found[0][0]], [s for _, s in found], np.repeat(x.gate, per)


def looked_up(texts: list[bytes], code: Code, tables: list, bits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``decisions``, with what the tables hold of the slots in place of these."""
    count, found = Records(texts, code, tables, bits)[0 : len(texts)]
    x = found.view(np.int8).reshape(-1, 4)
    return count, x[:, 3].view(np.uint8) & 1, x[:, :3].T, x[:, 3].view(np.uint8) >> 1


_POWERS: list[np.ndarray] = []


def chunks_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x2545F4914F6CDD1D
        inverse = pow(base, -1, 1 << 64)
        tables = []
        for b in (base, inverse):
            p, done, step = np.ones(max(n, 1 << 19), np.uint64), 1, b
            while done < len(p):
                k = min(done, len(p) - done)
                p[done : done + k] = p[:k] * np.uint64(step)
                step, done = step * step % (1 << 64), done + k
            tables.append(p)
        _POWERS[:] = tables
    return _POWERS[0], _POWERS[1]


def odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of a one from counts, in steps of 1 / SCALE."""
    return np.clip(np.rint(SCALE * np.log((ones + 0.3) / (zeros + 0.3))), -127, 127).astype(np.int8)


class Mixer:
    """Weights and refinement of lanes, each of which learns by itself. Odds are in steps of 1 / SCALE, so weights are divided by it."""

    def __init__(self, lanes: int):
        self.w = np.full((3, lanes * GATES), FIRST_WEIGHT / SCALE, np.float32)
        self.refine = np.zeros(lanes * GATES * LEVELS, np.float32)
        self.lane = np.arange(lanes, dtype=np.uint32) * np.uint32(GATES)

    def keep(self, lanes: int) -> None:
        """Lets all lanes go but the first."""
        if lanes < len(self.lane):
            self.w, self.lane, self.refine = np.ascontiguousarray(self.w[:, : lanes * GATES]), self.lane[:lanes], self.refine[: lanes * GATES * LEVELS]

    def __call__(self, odds: list[np.ndarray], one: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability that was given to each of the next decisions, [decisions, lanes]; odds: three of each, overwritten; one: the sign bit, where it is a one."""
        g = (gate + self.lane).astype(np.int64)
        x = self.w[0].take(g, mode="clip")
        x *= odds[0]
        for own, odd in zip(self.w[1:], odds[1:]):
            y = own.take(g, mode="clip")
            y *= odd
            x += y
        np.minimum(x, np.float32(9), out=x)
        np.maximum(x, np.float32(-9), out=x)
        y = x + np.float32(8)
        y *= np.float32(0.5)
        np.minimum(y, np.float32(LEVELS - 1), out=y)
        level = y.astype(np.int64)  # toward 0: the lowest from -10 on
        level += g * np.int64(LEVELS)
        x += self.refine.take(level, mode="clip")
        flipped = x.view(np.uint32)
        flipped ^= one
        np.exp(x, out=x)
        x += np.float32(1)
        p = np.float32(1) / x
        err = np.subtract(p, np.float32(1), out=x)
        flipped ^= one
        g = g.ravel()
        np.multiply(err, np.float32(REFINE), out=y)
        self.refine += np.bincount(level.ravel(), y.ravel(), len(self.refine)).astype(np.float32)
        err *= np.float32(RATE / SCALE**2)
        for own, odd in zip(self.w, odds):
            odd *= err
            own += np.bincount(g, odd.ravel(), own.size).astype(np.float32)
        return p


def mixed(s: np.ndarray, bit: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Cost in nats of each decision, [decisions, lanes]; s: [3, decisions, lanes] log odds."""
    mixer, s, one = Mixer(bit.shape[1]), s * np.float32(SCALE), bit.astype(np.uint32) << np.uint32(31)
    return -np.log(np.concatenate([mixer(list(s[:, t : t + STEP]), one[t : t + STEP], gate[t : t + STEP]) for t in range(0, len(bit), STEP)]))


def costs(runs: list[np.ndarray]) -> np.ndarray:
    """Cost in nats of each run of ``Records``, longest first, side by side as lanes."""
    size = np.array([len(r) for r in runs])
    # Rows of a length that is no power of 2: steps of all lanes would share few lines of the cache.
    held = np.zeros((len(runs), -(-int(size[0]) // STEP) * STEP + 16), np.uint32)
    for own, r in zip(held, runs):
        own[: len(r)] = r
    mixer, out = Mixer(len(runs)), np.zeros(len(runs))
    for t in range(0, int(size[0]), STEP):
        live = int(np.searchsorted(-size, -t, "left"))  # runs that go on
        mixer.keep(live)
        part = np.ascontiguousarray(held[:live, t : t + STEP].T)
        signed = part.view(np.int32)
        odds = [((signed << np.int32(24 - 8 * i)) >> np.int32(24)).astype(np.float32) for i in range(3)]
        p = mixer(odds, (part << np.uint32(7)) & np.uint32(1 << 31), part >> np.uint32(25))
        if size[live - 1] < t + STEP:
            p[np.arange(t, t + STEP)[:, None] >= size[:live]] = 1  # nothing beyond the end of a run
        # Products of four: no smaller than a float can hold.
        p = p.reshape(4, STEP // 4, live)
        for cost in np.log(p[0] * p[1] * (p[2] * p[3])):  # in this order, whatever runs are beside
            out[:live] -= cost
    return out


def lengths(texts: list[bytes], code: Code, tables: list, bits: tuple[int, int, int]) -> np.ndarray:
    """Code length in nats of each text; texts of any length, a bounded number of decisions at a time."""
    out = np.zeros(len(texts))
    runs: list[tuple[int, np.ndarray]] = []

    def flush(last: bool = False) -> None:
        nonlocal runs
        runs.sort(key=lambda r: -len(r[1]))  # the runs of a text keep their order: whole ones, then its last
        for i in range(0, len(runs) if last else len(runs) // LANES * LANES, LANES):
            some = runs[i : i + LANES]
            np.add.at(out, [j for j, _ in some], costs([r for _, r in some]))
        runs = [] if last else [(i, r.copy()) for i, r in runs[len(runs) // LANES * LANES :]]

    def some(lo: int, most: int, end: int) -> int:
        """texts[lo:this] have so many bytes, or little more."""
        size = 0
        while lo < end and size < most:
            size += len(texts[lo])
            lo += 1
        return lo

    lo = 0
    while lo < len(texts):
        end = some(lo, SHARED, len(texts))
        records, at = Records(texts[lo:end], code, tables, bits), lo
        while at < end:
            stop = some(at, AT_ONCE, end)
            count, found = records[at - lo : stop - lo]
            for i, own in zip(range(at, stop), np.split(found, np.cumsum(count)[:-1])):
                runs += [(i, own[x : x + RUN]) for x in range(0, len(own), RUN)]
            at = stop
            if len(runs) >= LANES:
                flush()
        lo = end
    flush(True)
    return out


def held_out(doc: int) -> bool:
    return zlib.crc32(b"" if doc == chunks.NO_DOC else str(doc).encode()) % 10 == 0


def range_bits(bits: int) -> int:
    """2 to this power is the number of ranges of a table of 2**bits slots."""
    return max(RANGES, bits - WIDE)


class Tally:
    """Counts of zeros and ones by slot, of one chunk; slots of held-out texts with none."""

    def __init__(self, bits: int):
        self.kind = np.uint32 if bits <= 30 else np.uint64
        self.raw: list = []
        self.size = 0
        self.keys, self.counts = np.zeros(0, self.kind), np.zeros(0, np.uint32)

    def add(self, slots: np.ndarray, bit: np.ndarray | None, weight: np.ndarray | None = None) -> None:
        key = slots.astype(self.kind) << self.kind(2) | (self.kind(2) if bit is None else bit)
        self.raw.append(self._joint(key, np.ones(len(slots), np.uint32) if weight is None else weight.astype(np.uint32)))
        self.size += len(slots)
        if self.size >= RAW:
            self.close()

    def _joint(self, key: np.ndarray, weight: np.ndarray):
        """Of keys of 32 bits: both in one number, which sorts faster and is held once."""
        if self.kind is np.uint64:
            return key, weight
        both = key.astype(np.uint64)
        both <<= np.uint64(32)
        both |= weight
        return both

    def close(self) -> None:
        if self.kind is np.uint32:
            both = np.concatenate([self._joint(self.keys, self.counts), *self.raw])
            self.raw, self.keys, self.counts = [], None, None
            both.sort()
            key = (both >> np.uint64(32)).astype(np.uint32)
            weight = both.astype(np.uint32)  # the low half
            del both
        else:
            key, weight = (np.concatenate(x) for x in zip((self.keys, self.counts), *self.raw))
            order = np.argsort(key)
            key, weight = key[order], weight[order]
        start = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1])))
        self.raw, self.size = [], 0
        self.keys, self.counts = key[start], np.add.reduceat(weight, start) if len(start) else weight

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slots in order, zeros, ones)."""
        self.close()
        slot, kind = self.keys >> self.kind(2), self.keys & self.kind(3)
        fresh = np.concatenate((slot[:1] == slot[:1], slot[1:] != slot[:-1]))
        place = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        first = np.flatnonzero(fresh)
        out = np.zeros((2, len(first)), np.uint32)
        for k in (0, 1):
            at = np.flatnonzero(kind == k)
            out[k, place.take(at)] = self.counts.take(at)
        return slot.take(first), *out


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, and so on."""
    return b"".join([(x >> x.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(x.itemsize)]) if x.itemsize > 1 else x.tobytes()


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if size == 1:
        return np.frombuffer(data, kind)
    raw = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = raw[0].astype(kind)
    for k in range(1, size):
        high = raw[k].astype(kind)
        high <<= high.dtype.type(8 * k)
        out |= high
    return out


def _shut(at: np.ndarray, *columns: np.ndarray) -> bytes:
    """Packed slots of a range, in order, and what belongs to each."""
    steps = np.diff(at.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return len(at).to_bytes(8, "little") + chunks.squeeze(_planes(steps) + b"".join(map(_planes, columns)))


def _open(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, raw, at, out = int.from_bytes(data[:8], "little"), chunks.unsqueeze(data[8:]), 0, []
    for kind in ("<u4", *kinds):
        size = n * np.dtype(kind).itemsize
        out.append(_unplanes(raw[at : at + size], kind))
        at += size
    out[0] = np.cumsum(out[0], dtype=np.int64)
    return out


class Sparse:
    """What a chunk got for its slots, indexed by slots as a whole table would be: the low bits of a slot name a cell, which holds its other bits, a mark and its value of a byte."""

    def __init__(self, slots: np.ndarray, values: np.ndarray, kind: type):
        bits = min(23, len(slots).bit_length() + 2)
        self.mask, self.high = kind((1 << bits) - 1), kind(bits)
        self.cell = np.uint32 if kind is np.uint32 and bits >= 9 else np.uint64  # the other bits of a slot are 23 at most
        slots = slots.astype(kind)
        low, own = slots & self.mask, self._marked(slots)
        own |= values.view(np.uint8)
        self.cells = np.zeros(int(self.mask) + 1, self.cell)
        self.cells[low] = own
        rest = np.flatnonzero(self.cells[low] != own)  # slots whose cell another one has
        self.others, self.rest = slots[rest], values[rest]

    def _marked(self, slots: np.ndarray) -> np.ndarray:
        return (slots >> self.high).astype(self.cell) << self.cell(9) | self.cell(256)

    def __getitem__(self, slots: np.ndarray) -> np.ndarray:
        got = self.cells.take((slots & self.mask).astype(np.int64))
        got ^= self._marked(slots)
        out = got.astype(np.uint8).view(self.rest.dtype)
        other = np.flatnonzero(got > self.cell(255))  # slots that share the low bits
        if len(other):
            found = np.searchsorted(self.others, slots[other])
            if not len(self.rest) or (self.others[np.minimum(found, len(self.others) - 1)] != slots[other]).any():
                raise ValueError("a slot without a reply")
            out[other] = self.rest[found]
        return out


def _gather(pairs: bytes, bits: tuple[int, int, int], buckets: int):
    """Of each chunk: words by bucket, and counts of slots by range (as buckets below 0)."""

    names = ["bucket", "chunk", "payload"]

    def of_chunk(row: dict, code: Code) -> pa.RecordBatch:
        own = [(held_out(doc), text.lower()) for doc, text in chunks.texts_of(row)]
        tallies = [Tally(b) for b in bits]
        pieces = Pieces([low for _, low in own])
        learnt = np.repeat([not out for out, _ in own], pieces.count)
        times = np.bincount(pieces.piece[learnt], minlength=len(pieces.size))
        for some, x in pieces.blocks():
            weight = np.repeat(times[some], pieces.size[some])
            for t, (tally, b) in enumerate(zip(tallies, bits)):
                number, first = x.numbers(t)
                n = np.bincount(number, weight).astype(np.int64)
                nth, slots = x.slots(t, first, code, b)
                n = np.repeat(n, code.size[x.symbol[first]])
                seen = np.flatnonzero(n)
                tally.add(slots.take(seen), code.bit.take(nth.take(seen)), n.take(seen))
                if len(seen) < len(n):
                    tally.add(slots[n == 0], None)  # of held-out texts alone
        del pieces
        known = words.Vocabulary([low for _, low in own])
        learnt = np.repeat([not out for out, _ in own], known.count)
        trained = np.bincount(known.number[learnt], minlength=len(known.words))
        found = dict(known.by_bucket(buckets))
        payload = [len(x).to_bytes(8, "little") + chunks.squeeze(trained[x].astype("<i8").tobytes() + b"\n".join([known.words[i] for i in x.tolist()])) for x in found.values()]
        bucket = list(found)
        for t, (tally, b) in enumerate(zip(tallies, bits)):
            slots, zeros, ones = tally.table()
            shift = b - range_bits(b)
            cut = np.searchsorted(slots, (np.arange((1 << range_bits(b)) + 1, dtype=np.uint64) << np.uint64(shift)))
            for r in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[r], cut[r + 1])
                bucket.append(-1 - 3 * r - t)
                payload.append(_shut(slots[own].astype(np.int64) - (r << shift), zeros[own].astype("<u4"), ones[own].astype("<u4")))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([row["chunk"]] * len(bucket), pa.int64()), pa.array(payload, pa.binary())], names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                alone()  # what the chunk before took is given back
                yield of_chunk(row, code_of(pairs))

    return run


def summed_slots(payloads: list[bytes], size: int) -> list[bytes]:
    """The log odds of all payloads together, for the slots of each; each payload is opened once, and only its slots are held in place of it."""
    zeros, ones = np.zeros((2, size), np.int64)
    own = []
    for i, p in enumerate(payloads):
        at, x, y = _open(p, "<u4", "<u4")
        zeros[at] += x
        ones[at] += y
        own.append(at.astype(np.uint32))
        payloads[i] = b""
    values = np.concatenate([odds(zeros[lo : lo + PIECE], ones[lo : lo + PIECE]) for lo in range(0, size, PIECE)])
    del zeros, ones
    return [_shut(at, values[at]) for at in own]


def _summed(bits: tuple[int, int, int]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if _PLACES or _POWERS:  # of counting, in the same worker
            _PLACES.clear()
            _POWERS.clear()
            alone()
        payloads = table.column("payload").to_pylist()
        chunk = table.column("chunk").to_pylist()
        if bucket < 0:
            b = bits[(-1 - bucket) % 3]
            reply = summed_slots(payloads, 1 << b - range_bits(b))
            n, v = [0] * len(reply), [0] * len(reply)
        else:
            total: dict[bytes, int] = {}
            parts = []
            for p in payloads:
                k = int.from_bytes(p[:8], "little")
                raw = chunks.unsqueeze(p[8:])
                counts = np.frombuffer(raw, "<i8", k).tolist()
                ws = raw[8 * k :].split(b"\n")
                parts.append(ws)
                for w, c in zip(ws, counts):
                    total[w] = total.get(w, 0) + c
            reply = [np.array([total[w] for w in ws], "<i8").tobytes() for ws in parts]
            reply = [chunks.squeeze(r) for r in reply]
            n, v = [0] * len(reply), [0] * len(reply)
            n[0], v[0] = sum(total.values()), sum(c > 0 for c in total.values())
        return pa.table({"bucket": pa.array([bucket] * len(reply), pa.int32()), "chunk": pa.array(chunk, pa.int64()), "payload": pa.array(reply, pa.binary()), "n": pa.array(n, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _replied(got: dict[int, bytes], bits: tuple[int, int, int]) -> list[Sparse]:
    """The tables of one chunk from the replies by range."""
    out = []
    for t, b in enumerate(bits):
        slots, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
        for r in range(1 << range_bits(b)):
            if p := got.get(-1 - 3 * r - t):
                at, x = _open(p, "i1")
                slots.append(at + (r << b - range_bits(b)))
                values.append(x)
        out.append(Sparse(np.concatenate(slots), np.concatenate(values), np.uint32 if b <= 32 else np.uint64))
    return out


def table_bits(nbytes: int) -> tuple[int, int, int]:
    """Slots of the tables of 2 bytes, 4 bytes and words, as powers of 2: in proportion to the corpus."""
    top = max(14, nbytes.bit_length() - 4)
    return top - 2, top - 1, top


def score(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    packed = chunks.pack(docs, scratch, CHUNK)

    def tally(batches) -> Iterator[pa.RecordBatch]:
        pairs, ends, size = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                own = [t.lower() for doc, t in chunks.texts_of(row) if not held_out(doc)]
                raw = np.frombuffer(b"".join([END + t for t in own]) + END, np.uint8).astype(np.int32)
                pairs += np.bincount(raw[:-1] << 8 | raw[1:], minlength=1 << 16)
                size += len(raw)
                ends += len(own)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int32()), pa.array([*pairs[at].tolist(), ends, size], pa.int64())], ["k", "n"])

    counted = dict(packed.mapInArrow(tally, "k int, n long").groupBy("k").agg(F.sum("n")).collect())  # 2**16 + 2 sums at most
    ends, nbytes = counted.pop(-1, 0), counted.pop(-2, 0)
    seen = np.array([counted.get(i, 0) for i in range(1 << 16)], np.int64)
    bits = table_bits(nbytes)
    buckets = spread(spark, nbytes, 16 << 20)
    sent = packed.mapInArrow(_gather(seen.tobytes(), bits, buckets), "bucket int, chunk long, payload binary")
    replies = scratch.stage(sent.groupBy("bucket").applyInArrow(_summed(bits), "bucket int, chunk long, payload binary, n long, v long"), "replies")
    n, v = replies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    release_shuffles(spark)  # after another job: the end of the one before, which holds the counts as sent, has been dealt with
    n, v = n + ends, v + bool(ends)
    pairs = seen.tobytes()

    def run(row: dict, own: list[dict]) -> Iterator[pa.Table]:
        code, texts = code_of(pairs), [(doc, t.lower()) for doc, t in chunks.texts_of(row)]
        got = {r["bucket"]: r["payload"] for r in own}
        floor = math.log10(n + 0.1 * (v + 1))
        known = words.Vocabulary([t for _, t in texts])
        counts = np.zeros(len(known.words), np.int64)
        for b, x in known.by_bucket(buckets):
            counts[x] = np.frombuffer(chunks.unsqueeze(got[b]), "<i8")
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[known.number])))[np.concatenate(([0], np.cumsum(known.count)))])  # noqa: E731  of each text
        logs = np.log10(counts + 0.1) - floor
        end, base = math.log10(ends + 0.1) - floor, [math.fsum(x) for x in np.split(logs[known.number], np.cumsum(known.count)[:-1])]
        seen = total((counts > 0).astype(np.int64)) + bool(ends)
        nats = lengths([t for _, t in texts], code, _replied(got, bits), bits)
        rows = []
        for (doc, text), size, k, x, cost in zip(texts, known.count.tolist(), seen.tolist(), base, nats.tolist()):
            rows.append((None if doc == chunks.NO_DOC else doc, held_out(doc), size + 1, k, n, x + end, -cost / math.log(10), cost / math.log(2) / (len(text) + 1)))
        kinds = (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64()))
        yield pa.table({c: pa.array(x, t) for (c, t), x in zip(kinds, zip(*rows))})

    answers = replies.select("chunk", "bucket", "payload")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    out = scratch.stage(chunks.with_replies(packed, answers, run, schema), "out")
    scratch.drop("chunks", "replies")
    return out


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
