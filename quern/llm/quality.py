"""Operator 8: quality rules by line sequence labelling.

A linear-chain conditional random field labels a document's lines as content or boilerplate (Viterbi
decoding); the share of words in content lines decides. It is trained here on a bounded sample of labelled
documents (``TRAIN_DOCS``, a parameter): each line takes its document's quality as label, and documents are cut into runs of 32 lines for the fit. Hard rules come first.

Cases: null and empty text: no words, so it fails the word rule; lines without a word are skipped;
no usable labels (none, or one class): ``DEFAULT`` weights; labels that contradict each other or name no document: ignored or
averaged by the fit; repeated rows each give a row; an empty table gives an empty table; other columns are ignored or,
with keep_columns, stay, but those named like a result are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import alone, utf8

TRAIN_DOCS = 2_000
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 50, 50, 0.5
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, SHOUT = bytes(range(65, 91)), bytes(range(48, 58)), b"!^~=_{}[]\\@+"
NOT_WORD_POINT = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
FEATURES = ("bias", "symbols", "capitals", "digits", "marks", "length of words", "number of words", "repeated line", "repeated words", "full stop")
#: Emission weights (content against boilerplate), then stay-or-change weights: used when there is nothing to learn from.
DEFAULT = (np.array([2.0, -30.0, -6.0, -10.0, -20.0, 0.0, 0.0, -2.0, -3.0, 0.5]), np.array([[1.0, -1.0], [-1.0, 1.0]]))


def features(text: bytes) -> tuple[np.ndarray, list[int]]:
    """One row of FEATURES for each line that has a word, and the lines' numbers of words."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        k = len(line)
        chars = sum(map(len, words)) or 1
        rows.append((1.0, (k - len(line.translate(None, SYMBOLS))) / chars, (k - len(line.translate(None, UPPER))) / chars, (k - len(line.translate(None, DIGITS))) / chars,
                     (k - len(line.translate(None, SHOUT))) / chars, np.log(chars / n) - 1.6, np.log(n) / 3 - 1, float(line in seen), 1 - len(set(words)) / n, float(line.rstrip()[-1:] in (b".", b"!", b"?"))))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES)), sizes


def train(docs: list[tuple[np.ndarray, int]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3, piece: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Weights that maximise the conditional likelihood of constant label sequences: exact forward-backward, Adam."""
    if len({y for _, y in docs}) < 2:
        return DEFAULT
    cuts = [(x[i : i + piece], y) for x, y in docs for i in range(0, len(x), piece)]
    x = np.zeros((len(cuts), piece, len(FEATURES)))
    on, label = np.zeros((len(cuts), piece), bool), np.array([y for _, y in cuts])
    for i, (rows, _) in enumerate(cuts):
        x[i, : len(rows)], on[i, : len(rows)] = rows, True
    rate_of = np.bincount(label, weights=on.sum(1), minlength=2)
    weight = (on.sum() / 2 / np.maximum(rate_of, 1))[label][:, None] * on  # both classes count alike
    theta = np.concatenate((np.zeros(len(FEATURES)), np.array([0.5, -0.5, -0.5, 0.5])))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        e = np.stack((np.zeros(x.shape[:2]), x @ w), 2)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for i in range(1, piece):
            fwd[:, i] = np.logaddexp(fwd[:, i - 1, :1] + t[0], fwd[:, i - 1, 1:] + t[1]) + e[:, i]
        for i in range(piece - 2, -1, -1):
            after = e[:, i + 1] + bwd[:, i + 1]
            bwd[:, i] = np.where(on[:, i + 1, None], np.logaddexp(t[:, 0] + after[:, :1], t[:, 1] + after[:, 1:]), 0)
        z = np.logaddexp(*(fwd + bwd)[:, 0].T)
        p1 = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None])
        grad_w = (((label[:, None] - p1) * weight)[..., None] * x).sum((0, 1))
        pair = np.exp(fwd[:, :-1, :, None] + t + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * weight[:, 1:, None, None]
        have = np.zeros((2, 2))
        np.add.at(have, (label, label), weight[:, 1:].sum(1))
        grad = np.concatenate((grad_w, (have - pair.sum((0, 1))).ravel())) / on.sum() - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def viterbi(emission: list[float], t: list[list[float]]) -> list[int]:
    """Best labels (1: content) when boilerplate emits 0 and content the given scores."""
    (t00, t01), (t10, t11) = t
    a = b = None
    back = []
    for s in emission:
        if a is None:
            a, b = 0.0, s
            continue
        from0, from1 = a + t01, b + t11
        stay0, drop1 = a + t00, b + t10
        back.append((drop1 > stay0, from1 >= from0))
        a, b = max(stay0, drop1), max(from0, from1) + s
    if a is None:
        return []
    path = [int(b >= a)]
    for to0, to1 in reversed(back):
        path.append(int(to1 if path[-1] else to0))
    return path[::-1]


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += bool(line.strip())
        else:
            seen.add(line)
    repeat, n = 0, len(words)
    if n > 3:
        grams = Counter(zip(words, words[1:], words[2:]))
        if len(grams) < n - 2:
            to = 0  # words before it are counted
            for i, g in enumerate(zip(words, words[1:], words[2:])):
                if grams[g] > 1:
                    repeat += i + 3 - max(i, to)
                    to = i + 3
    return n, len(text.translate(None, NOT_WORD_POINT)), len(text) - len(text.translate(None, SYMBOLS)), dup, repeat


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Weights from at most ``most`` labelled documents, those of the smallest hashes; the driver gets line features alone."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t)[0] for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality").cast(pa.int32()), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    # Broadcast: at most ``most`` pairs of numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(rows, "doc_id long, quality int, x binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    return train([(x, int(r["quality"] > 0)) for r in found if len(x := np.frombuffer(r["x"], "<f4").reshape(-1, len(FEATURES)).astype(float))])


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep_columns: bool = False) -> DataFrame:
    """(doc_id, counts, content_share, base_failed, kept); with keep_columns the columns of docs before them."""
    w, t = model[0].tolist(), model[1].tolist()
    out = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())])
    own = [c for c in docs.columns if c.lower() not in out.names] if keep_columns else ["doc_id"]

    def verdicts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for b in batches:
            rows = []
            for text in utf8(b.column("text")):
                base = counts(text)
                x, sizes = features(text)
                path = viterbi((x @ np.array(w)).tolist(), t)
                share = sum(n for n, y in zip(sizes, path) if y) / max(1, sum(sizes))
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
                rows.append((*base, failed, not failed and share >= MIN_CONTENT, share))
            columns = list(zip(*rows)) or [[]] * len(out)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(pa.array(c, f.type) for c, f in zip(columns, out))], [*own, *out.names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(own).schema), "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"])
    return docs.select(*own, *([] if "text" in own else ["text"])).mapInArrow(verdicts, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("content_share")
