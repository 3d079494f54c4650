"""Operator 2: SentencePiece encoding and decoding by a streaming Viterbi over piece boundaries.

The model file is a byte-pair model, whose ids are the ones that merging gives. Its segmentations have a
Viterbi form: the last piece of the encoding of each prefix is unique, and a piece ending at i follows
the last piece of the prefix before it exactly if that pair encodes to itself. So each boundary has one
surviving backpointer; ``stream`` keeps a window of boundaries, and as soon as the paths back from the last ``longest`` of them
meet in one boundary it commits the ids before that.
Ids equal those of the sentencepiece library (tested), whose normaliser in this model is the identity with a dummy space in front.

Two characters that stand side by side in no piece (a letter and a space after it, a line feed and anything) have a boundary between
them on every path, whatever comes: texts are cut there into units, and what ``stream`` committed for a unit is remembered for
the next time that it comes. A text is read in blocks of bounded size; beside a block and the window only the ids grow with the text.

Cases: null and empty text have no ids; characters outside the vocabulary become byte pieces; U+2581 in a text
decodes to a space, as in the library, and is reported as not restored; repeated rows each give a row; a null doc_id comes back null; columns
that are not to be kept are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm import words
from quern.llm.common import alone, remembered, utf8

SPACE = "▁"
#: Distinct units and pairs of pieces that a worker remembers; beyond it the memory is emptied, which changes speed alone.
UNIT_CACHE, PAIR_CACHE = 2_500_000, 400_000
#: Bytes of text whose units are looked up at once.
BLOCK = 1 << 20


@remembered
@functools.lru_cache(1)
def pieces_of(path: str) -> Pieces:
    """One per Python worker: what it remembers serves all of the worker's tasks."""
    return Pieces(path)


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids, self.rank, self.bytes = {}, {}, [b""] * n
        self.byte_ids = [0] * 256
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)], self.bytes[i] = i, bytes([int(p[3:5], 16)])
            elif not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_unused(i):
                self.ids[p], self.rank[p], self.bytes[i] = i, -sp.get_score(i), p.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.ids))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.spines: dict[tuple[str, int], list[tuple[float, str]]] = {}
        # Bytes that may stand side by side inside a piece; those of characters outside ASCII always may.
        self.beside = np.ones((256, 256), bool)
        self.beside[:128, :128] = False
        for p in self.ids:
            x = p.replace(SPACE, " ").encode()
            for u, v in zip(x, x[1:]):
                self.beside[u, v] = True
        self.numbers = words.Numbers(UNIT_CACHE, self._new, self._clear)
        self._clear()
        self.spelt = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.spelt_size = np.array(list(map(len, self.bytes)), np.int64)
        self.spelt_at = np.cumsum(self.spelt_size) - self.spelt_size

    def merged(self, text: str, watch: int = 0) -> list:
        """Byte-pair merging of a short text; with watch -1 or 1 the last or first symbol's course: (highest rank so far, symbol)."""
        parts, rank = list(text), self.rank
        course, high = [(0.0, parts[-1] if watch < 0 else parts[0])], 0.0
        while True:
            best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
            if best is None:
                return course if watch else parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            high = max(high, best[0])
            end = parts[-1] if watch < 0 else parts[0]
            if end != course[-1][1]:
                course.append((high, end))

    def spine(self, piece: str, side: int) -> list[tuple[float, str]]:
        found = self.spines.get((piece, side))
        if found is None:
            found = self.spines[piece, side] = self.merged(piece, side)
        return found

    def follows(self, a: str, b: str) -> bool:
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > PAIR_CACHE:
                self.pairs.clear()
            ok = self.pairs[key] = self._apart(self.spine(a, -1), self.spine(b, 1))
        return ok

    def _apart(self, left: list[tuple[float, str]], right: list[tuple[float, str]]) -> bool:
        """No merge crosses the boundary: none of the symbols that meet there makes a piece before one of them is merged away."""
        rank, i, j, never = self.rank, 0, 0, float("inf")
        while True:
            up_left = left[i + 1][0] if i + 1 < len(left) else never
            up_right = right[j + 1][0] if j + 1 < len(right) else never
            cross = rank.get(left[i][1] + right[j][1], never)
            if cross < up_left and cross <= up_right and cross < never:
                return False
            if up_left == up_right == never:
                return True
            if up_left <= up_right:
                i += 1
            else:
                j += 1

    def stream(self, chars: Iterable[str]) -> Iterator[str]:
        """Pieces of a stream of characters (spaces already U+2581), committed as early as paths meet."""
        ids, follows, longest, pairs = self.ids, self.follows, self.longest, self.pairs
        window, last = "", None  # characters after the committed boundary; the piece before it
        back: list[tuple[int, str] | None] = [None]  # per boundary of the window: where its last piece starts, and that piece
        i = 0
        for ch in chars:
            window += ch
            i += 1
            for j in range(i - longest if i > longest else 0, i):
                piece = window[j:]
                if piece in ids or i - j == 1:
                    before = back[j][1] if j else last
                    if before is None or ((ok := pairs.get((before, piece))) is None and follows(before, piece)) or ok:
                        back.append((j, piece))
                        break
            else:
                raise AssertionError("a prefix without an encoding")
            if i >= longest:  # the survivors are the last ``longest`` boundaries: commit up to where their paths meet
                ends = set(range(i - longest + 1, i + 1))
                while len(ends) > 1:
                    e = max(ends)
                    ends.discard(e)
                    ends.add(back[e][0])
                cut = ends.pop()
                if cut:
                    done, e = [], cut
                    while e:
                        done.append(back[e][1])
                        e = back[e][0]
                    yield from reversed(done)
                    last, window, i = done[0], window[cut:], i - cut
                    back = [None] + [(x[0] - cut, x[1]) if x and x[0] >= cut else None for x in back[cut + 1 :]]  # others lie on no path
        done, e = [], len(window)
        while e:
            done.append(back[e][1])
            e = back[e][0]
        yield from reversed(done)

    def unit(self, unit: str) -> list[int]:
        out: list[int] = []
        for p in self.stream(unit.replace(" ", SPACE)):
            i = self.ids.get(p)
            if i is None:
                out += [self.byte_ids[c] for c in p.encode()]
            else:
                out.append(i)
        return out

    def _clear(self) -> None:
        self.found = words.Lists("i4")

    def _new(self, found: list[bytes]) -> None:
        self.found.extend([self.unit(u.decode()) for u in found])

    def _block(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids before each place of at) of a block of texts, each with its dummy space; units begin at the places of at."""
        x = np.frombuffer(raw, np.uint8)
        begin = np.ones(len(x), bool)
        begin[1:] = ~self.beside[x[:-1], x[1:]]
        begin[at] = True
        starts = np.flatnonzero(begin)
        number = self.numbers(raw + b" " * 16, starts, np.append(starts[1:], len(x)))
        ids, size = self.found[number]
        return ids, np.concatenate(([0], np.cumsum(size)))[np.searchsorted(starts, at)]

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, as int32; a bounded number of bytes at a time."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        block, owner, size = [], [], 0

        def flush() -> None:
            nonlocal size
            if block:
                at = np.cumsum([0, *map(len, block)])[:-1]
                ids, before = self._block(b"".join(block), at)
                for i, own in zip(owner, np.split(ids, before[1:])):
                    out[i].append(own)
            block.clear()
            owner.clear()
            size = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            text, lo = b" " + text.replace(SPACE.encode(), b" "), 0
            while lo < len(text):
                hi = len(text) if len(text) - lo <= BLOCK else self._edge(text, lo + BLOCK)
                block.append(text[lo:hi])
                owner.append(i)
                size += hi - lo
                lo = hi
                if size >= BLOCK:
                    flush()
        flush()
        return [own[0] if len(own) == 1 else np.concatenate(own) if own else np.zeros(0, np.int32) for own in out]

    def _edge(self, text: bytes, least: int) -> int:
        """The first place from ``least`` on where a unit begins."""
        while least < len(text):
            x = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - least + 1), least - 1)
            cut = np.flatnonzero(~self.beside[x[:-1], x[1:]])
            if len(cut):
                return least + int(cut[0])
            least += len(x) - 1
        return len(text)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text.encode()])[0].tolist()

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, with the dummy space."""
        return self.spelt[words.ragged(self.spelt_at[ids], self.spelt_size[ids])].tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        table = self.bytes
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """(doc_id, keep..., n_pieces, ids array<int>, ids_crc32, restored) of docs (doc_id, text); ids are decoded again and compared. with_ids: else without ids."""
    last = (["ids"] if with_ids else []) + ["ids_crc32", "restored"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(pieces_of)
        pieces = pieces_of(model)
        for b in batches:
            for i in range(0, b.num_rows, 256):  # small batches: ids take more room than their texts
                own = b.slice(i, 256)
                texts = utf8(own.column("text"))
                ids = pieces.encode_all(texts)
                back = [pieces.spell(x)[1:] for x in ids]
                sizes = np.array([len(x) for x in ids], np.int64)
                columns = [own.column(c) for c in ("doc_id", *keep)] + [pa.array(sizes)]
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype("i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))
                columns += [pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()), pa.array([x == y for x, y in zip(back, texts)])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "n_pieces", *last])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select("doc_id", *keep).schema)
    kinds = {"ids": "array<int>", "ids_crc32": "long", "restored": "boolean"}
    return docs.select("doc_id", *keep, "text").mapInArrow(rows, f"{own}, n_pieces long, {', '.join(f'{c} {kinds[c]}' for c in last)}")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
