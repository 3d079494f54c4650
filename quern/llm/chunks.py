"""Packed chunks of documents, for operators that read the texts several times.

A chunk is a row of a few MB of whole documents (one over-long document is a chunk of its own), written once to the
shared folder. Tasks exchange sorted arrays per chunk and hash bucket instead of a row for each word or place,
so that even a key found everywhere arrives once for each chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quern.llm.common import CHUNK_BYTES, Scratch, utf8

NO_DOC = -(1 << 63)  # stands for a null doc_id: before all others
COLUMNS = "chunk long, n_bytes long, doc_ids binary, sizes binary, blob binary"


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(docs: DataFrame, scratch: Scratch, limit: int = CHUNK_BYTES) -> DataFrame:
    """Staged chunks of docs (doc_id, text); null text is empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            columns = [(part << 32) + seq], [size], [np.array(ids, "<i8").tobytes()], [np.array([len(t) for t in texts], "<i8").tobytes()], [squeeze(b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], ["chunk", "n_bytes", "doc_ids", "sizes", "blob"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text"))):
                if texts and size + len(text) > limit:
                    yield row()
                    seq, ids, texts, size = seq + 1, [], [], 0
                ids.append(NO_DOC if doc is None else doc)
                texts.append(text)
                size += len(text)
        if texts:
            yield row()

    return scratch.stage(docs.select("doc_id", "text").mapInArrow(run, COLUMNS), "chunks")


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(doc_ids, sizes in bytes, all texts joined)."""
    return np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["sizes"], "<i8"), unsqueeze(row["blob"])


def texts_of(row: dict) -> Iterator[tuple[int, bytes]]:
    ids, sizes, blob = unpack(row)
    at = 0
    for doc, n in zip(ids.tolist(), sizes.tolist()):
        yield doc, blob[at : at + n]
        at += n


def with_replies(chunks: DataFrame, replies: DataFrame, run: Callable[[dict, list[dict]], Iterator[pa.Table]], schema: str) -> DataFrame:
    """run(chunk, its replies) for each chunk; replies has a column chunk. The one exchange of texts that a pass costs."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        own = right.to_pylist()
        return pa.concat_tables([t for row in left.to_pylist() for t in run(row, own)])

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(both, schema)
