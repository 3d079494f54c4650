"""Operator 9: token ids in a binary format, static range asymmetric numeral system (rANS).

One table of quantised frequencies is shared by all files. A file (shard) holds documents of ascending
doc_id; its ids are cut into blocks of ``BLOCK`` ids that decode independently. In a block ``LANES``
states are interleaved: id i belongs to lane i mod LANES, and all lanes read one stream of 32-bit words.
A checkpoint per block holds the first id's place, the number of words, the CRC-32 of the words and the
lanes' states, so that blocks can be decoded in parallel and any damage shows.

A file's bytes, little-endian: magic ``QRNS``, uint32 version, n_docs, n_blocks, uint64 n_ids, uint64 first
(ids before, in its part), uint32 CRC-32 of the frequency table; int64 doc_id and uint32 count of each
document; of each block uint32 ids, words, CRC-32 and LANES uint64 states; then the words. Files are the
``file`` column of a Parquet table (one row each), so Spark's commit protocol makes them safe against lost
and repeated tasks on any store.

Cases: null text is an empty document (the end id alone); a null doc_id sorts first and comes back null;
repeated doc_ids are kept, ordered by their encoded ids; an empty table gives an empty table; other columns are ignored;
a vocabulary of more than 65,536 ids is an error.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import words
from quern.llm.common import Scratch, alone, release_shuffles, remembered, utf8

BLOCK, LANES = 16_384, 32
BITS = 20  # of the quantised frequencies: they sum to 2**BITS
LOW = np.uint64(1 << 31)
END_ID = 2
NO_DOC = -(1 << 63)  # stands for a null doc_id inside a file
HEAD = struct.Struct("<4sIIIQQI")
#: Distinct words whose ids a worker remembers; older ones are forgotten, which changes speed alone.
WORD_CACHE = 2_000_000
#: Bytes of text whose words are looked up at once; parts of a data set.
AT_ONCE, MOST_PARTS = 2 << 20, 10_000


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    The vocabulary's normaliser and pre-tokeniser drop white space and match nothing across it, so a text's
    ids are those of its white-space-separated words in turn. A run of letters ends before a mark such as a full stop, so words are cut there
    too; each distinct part is encoded once. Ids are of 16 bits.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("a vocabulary of more than 65,536 ids")
        self.numbers = words.Numbers(WORD_CACHE, self._new, self._clear)
        self._clear()

    def _clear(self) -> None:
        self.ids = words.Lists("<u2")

    def _new(self, found: list[bytes]) -> None:
        for i in range(0, len(found), 4096):  # the library's results take much room
            self.ids.extend([e.ids for e in self.tok.encode_batch_fast([w.decode() for w in found[i : i + 4096]], add_special_tokens=False)])

    def flat(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of each text's), with an end id after each text where one is given."""
        # The normaliser lower-cases all but special tokens.
        own = [t if b"<|" in t else t.lower() for t in texts]
        sizes = np.array([len(t) + 1 for t in own], np.int64)
        raw = b" " + b" ".join(own) + b" " * 17
        starts, ends = words.parts(np.frombuffer(raw, np.uint8))
        ids, size = self.ids[self.numbers(raw, starts, ends)]
        of_text = np.concatenate(([0], np.searchsorted(starts, np.cumsum(sizes) + 1)))
        total = np.concatenate(([0], np.cumsum(size)))[of_text]
        if end is not None:
            ids = np.insert(ids, total[1:], end)
            return ids, np.diff(total) + 1
        return ids, np.diff(total)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Per text its ids as little-endian uint16."""
        ids, counts = self.flat(texts)
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


@remembered
@functools.lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    """One per Python worker: what it remembers serves all of the worker's tasks."""
    return WordEncoder(path)


def quantised(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each id that occurs."""
    total = 1 << bits
    n = counts.sum()
    if not n:
        counts, n = np.ones_like(counts), len(counts)
    freq = np.where(counts > 0, np.maximum(1, counts * (total - np.count_nonzero(counts)) // n), 0).astype(np.int64)
    freq[np.argmax(counts)] += total - freq.sum()
    return freq


class Table:
    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.freq, self.bits = freq.astype(np.uint64), bits
        self.cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq.astype(np.int64))
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())


def encode_blocks(ids: np.ndarray, table: Table) -> tuple[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Per block (number of ids, lane states, words); all blocks advance together."""
    if not len(ids):
        return []
    nb = -(-len(ids) // BLOCK)
    steps = BLOCK // LANES
    full = np.zeros(nb * BLOCK, np.uint16)
    full[: len(ids)] = ids
    live = (np.arange(nb * BLOCK) < len(ids)).reshape(nb, steps, LANES)
    full = full.reshape(nb, steps, LANES)
    if nb == 1:  # short file: no steps beyond its ids
        steps = -(-len(ids) // LANES)
    x = np.full((nb, LANES), LOW, np.uint64)
    emit, words = np.zeros((nb, steps, LANES), bool), np.zeros((nb, steps, LANES), np.uint32)
    bits, top = np.uint64(table.bits), np.uint64(63 - table.bits)
    for t in range(steps - 1, -1, -1):
        f, c, on = table.freq[full[:, t]], table.cum[full[:, t]], live[:, t]
        f = np.where(on, f, np.uint64(1))
        out = on & (x >= f << top)
        emit[:, t], words[:, t] = out, x
        x = np.where(out, x >> np.uint64(32), x)
        q = x // f
        x = np.where(on, (q << bits) + (x - q * f) + c, x)
    per = emit.reshape(nb, -1).sum(1)
    stream = np.split(words[emit], np.cumsum(per)[:-1])
    return [(min(BLOCK, len(ids) - b * BLOCK), x[b], stream[b]) for b in range(nb)]


def decode_blocks(blocks: list[tuple[int, np.ndarray, np.ndarray]], table: Table) -> np.ndarray:
    if not blocks:
        return np.zeros(0, np.uint16)
    n = np.array([b[0] for b in blocks])
    x = np.stack([b[1] for b in blocks]).astype(np.uint64)
    start = np.concatenate(([0], np.cumsum([len(b[2]) for b in blocks])))
    stream = np.concatenate([*(b[2] for b in blocks), np.zeros(1, np.uint32)]).astype(np.uint64)
    at, steps = start[:-1].copy(), -(-int(n.max()) // LANES)
    out = np.zeros((len(blocks), steps, LANES), np.uint16)
    mask, bits, lane = np.uint64((1 << table.bits) - 1), np.uint64(table.bits), np.arange(LANES)
    for t in range(steps):
        on = t * LANES + lane < n[:, None]
        slot = x & mask
        s = table.symbol[slot]
        out[:, t] = s
        x = np.where(on, table.freq[s] * (x >> bits) + slot - table.cum[s], x)
        need = on & (x < LOW)
        place = at[:, None] + np.cumsum(need, 1) - 1
        x = np.where(need, (x << np.uint64(32)) | stream[np.where(need, place, len(stream) - 1)], x)
        at += need.sum(1)
    if not (at == start[1:]).all() or not (x == LOW).all():
        raise ValueError("damaged file: a block does not end in the initial state")
    return np.concatenate([out[b].reshape(-1)[: n[b]] for b in range(len(blocks))])


def write_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, first: int, table: Table) -> bytes:
    blocks = encode_blocks(ids, table)
    parts = [HEAD.pack(b"QRNS", 1, len(doc_ids), len(blocks), len(ids), first, table.crc), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes()]
    streams = [w.astype("<u4").tobytes() for _, _, w in blocks]
    for (n, states, words), raw in zip(blocks, streams):
        parts += [struct.pack("<III", n, len(words), zlib.crc32(raw)), states.astype("<u8").tobytes()]
    return b"".join(parts + streams)


def read_file(data: bytes, table: Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(ids before this file, doc_ids, counts, ids); raises ValueError on any damage."""
    magic, version, n_docs, n_blocks, n_ids, first, crc = HEAD.unpack_from(data)
    if magic != b"QRNS" or version != 1 or crc != table.crc:
        raise ValueError("not a file of this format and frequency table")
    at = HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    counts = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    heads = []
    for _ in range(n_blocks):
        heads.append((*struct.unpack_from("<III", data, at), np.frombuffer(data, "<u8", LANES, at + 12)))
        at += 12 + 8 * LANES
    blocks = []
    for n, words, check, states in heads:
        raw = data[at : at + 4 * words]
        if zlib.crc32(raw) != check:
            raise ValueError("damaged file: checksum of a block")
        blocks.append((n, states, np.frombuffer(raw, "<u4")))
        at += 4 * words
    ids = decode_blocks(blocks, table)
    if len(ids) != n_ids or counts.sum() != n_ids:
        raise ValueError("damaged file: number of ids")
    return first, doc_ids, counts, ids


def _cuts(docs: DataFrame, per_part: int) -> list[int]:
    """Approximate quantiles of doc_id that cut docs into parts of per_part bytes about; at most ``MOST_PARTS`` parts."""
    n, nbytes = docs.agg(F.count("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = min(MOST_PARTS, -(-nbytes // per_part))
    if parts < 2 or not n:
        return []
    found = docs.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(c) for c in found})


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value for each size, out of data in turn."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def encode(docs: DataFrame, vocabulary: str, out: Scratch, per_shard: int = 8 << 20) -> tuple[DataFrame, Table]:
    """Writes the files of docs (doc_id, text) and returns (the table of files (part, seq, n_ids, file), the frequency table).

    Documents are dealt to parts by ranges of doc_id and sorted inside a part, which is then cut into files of ``per_shard`` bytes of 32-bit ids at most, or of
    one longer document. In the head of a file ``first`` counts from the start of its part.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    cuts = np.array(_cuts(docs, 4 * per_shard), np.int64)  # at most MOST_PARTS numbers

    def ids_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(encoder_of)
        encoder = encoder_of(vocabulary)
        for b in batches:
            texts, lo = utf8(b.column("text")), 0
            while lo < len(texts):  # a bounded number of bytes at a time
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= AT_ONCE):
                    size += len(texts[hi])
                    hi += 1
                ids, counts = encoder.flat(texts[lo:hi], END_ID)
                doc = b.column("doc_id").slice(lo, hi - lo)
                part = np.searchsorted(cuts, doc.fill_null(NO_DOC).to_numpy(), side="left").astype("i4")
                yield pa.RecordBatch.from_arrays([pa.array(part), doc, _binaries(ids, 2 * counts)], ["part", "doc_id", "ids"])
                lo = hi

    def filed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()  # a worker that has encoded need not remember words any more
        own: list[tuple[int, bytes]] = []
        state = {"part": None, "seq": 0, "first": 0, "size": 0}

        def row() -> pa.RecordBatch:
            counts = np.array([len(x) // 2 for _, x in own], "<u4")
            values = state["part"], state["seq"], state["first"], state["size"], np.array([d for d, _ in own], "<i8").tobytes(), counts.tobytes(), b"".join([x for _, x in own])
            own.clear()
            state.update(seq=state["seq"] + 1, first=state["first"] + state["size"], size=0)
            kinds = (("part", pa.int32()), ("seq", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, kinds)], [c for c, _ in kinds])

        for b in batches:
            for part, doc, ids in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                if own and (part != state["part"] or 4 * state["size"] + 2 * len(ids) > per_shard):
                    yield row()
                if part != state["part"]:
                    state.update(part=part, seq=0, first=0)
                own.append((NO_DOC if doc is None else doc, ids))
                state["size"] += len(ids) // 2
        if own:
            yield row()

    dealt = docs.mapInArrow(ids_of, "part int, doc_id long, ids binary").repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    raw = out.stage(dealt.mapInArrow(filed, "part int, seq long, first long, n_ids long, doc_ids binary, counts binary, ids binary"), "ids")
    release_shuffles(spark)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(x, "<u2"), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = np.zeros(1 << 16, np.int64)  # at most as many rows as the vocabulary has ids
    for r in raw.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    freq = quantised(counts)
    shipped = spark.sparkContext.broadcast(freq.astype(np.int64).tobytes())  # 2**16 numbers

    def files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(np.frombuffer(shipped.value, np.int64))
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                data = write_file(np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["counts"], "<u4"), np.frombuffer(r["ids"], "<u2"), r["first"], table)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["seq"]], pa.int64()), pa.array([r["n_ids"]], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_ids", "file"])

    written = out.stage(raw.mapInArrow(files, "part int, seq long, n_ids long, file binary"), "files")
    out.drop("ids")
    return written, Table(freq)


def decode(files: DataFrame, freq: np.ndarray, crc: bool = False) -> DataFrame:
    """Reads files back: (doc_id, start, n_tokens, ids as little-endian uint32), or with crc their CRC-32 in place of the ids."""
    shipped = files.sparkSession.sparkContext.broadcast(freq.astype(np.int64).tobytes())
    sums = sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_ids")).collect())  # at most MOST_PARTS
    bases = dict(zip((p for p, _ in sums), np.concatenate(([0], np.cumsum([n for _, n in sums]))).tolist()))
    last = "ids_crc32" if crc else "ids"

    def docs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(np.frombuffer(shipped.value, np.int64))
        for b in batches:
            for part, data in ((p.as_py(), x.as_py()) for p, x in zip(b.column("part"), b.column("file"))):
                first, doc_ids, counts, ids = read_file(data, table)
                first += bases[part]
                ends = np.cumsum(counts, dtype=np.int64)
                for i in range(0, len(doc_ids), 512):
                    own = slice(i, i + 512)
                    rows = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends[own].tolist(), counts[own].tolist())]
                    rows = pa.array(map(zlib.crc32, rows), pa.int64()) if crc else pa.array(rows, pa.binary())
                    names = pa.array([None if d == NO_DOC else d for d in doc_ids[own].tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([names, pa.array(first + ends[own] - counts[own], pa.int64()), pa.array(counts[own], pa.int64()), rows], ["doc_id", "start", "n_tokens", last])

    return files.select("part", "file").mapInArrow(docs, f"doc_id long, start long, n_tokens long, {last} {'long' if crc else 'binary'}")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = Scratch(spark, "tokens")
    files, table = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), out)
    return decode(files, table.freq, crc=True)
