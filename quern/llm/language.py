"""Operator 11: language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

Text is lower-cased, runs of what is no letter become one gap, and n-grams of one to ``GRAMS`` code points are hashed to ``FEATURES`` places.
Document frequencies count every document that may be learned from. The regression is fitted on a bounded sample of them (``PER_LANG`` and ``TRAIN_DOCS``):
follow-the-regularised-leader with a learning rate for each coordinate, whose first penalty keeps weights at zero until their evidence passes it and whose second one
shrinks them. A fifth of the sample is kept from the fit and sets the temperature of the softmax, so that scores are probabilities.
Learning and prediction see the text alone: language only as what is learned, the number of a document only to hold a fifth of them out.

Cases: null text, or text without a letter: ``und`` with score 0; a null doc_id is held out (the CRC-32 of nothing is 0) and comes back null; null languages are not
learned from; with one language everything is that one; with none everything is ``und`` with score 0; texts of any length are read in blocks of ``CHARS`` code points; repeated rows
count each; ties go to the smallest language; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import alone, remembered

GRAMS, FEATURES, CHARS = 3, 1 << 15, 1 << 18
#: Sample of the fit: so many documents of a language, those of the smallest hashes, and so many in all, languages in turn.
PER_LANG, TRAIN_DOCS = 500, 4_000
#: Follow-the-regularised-leader: rate, its softening, first and second penalty, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 0.1, 0.001, 4
FOLDS = 5
UNKNOWN = "und"


@remembered
@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers) of the n-grams of a text; none if it has no letter."""
    total = np.zeros(FEATURES, np.int64)
    tail = np.zeros(1, np.uint32)  # a gap before the text
    some = False
    for lo in range(0, len(text), CHARS):
        points = np.frombuffer(text[lo : lo + CHARS].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = letters()[points]
        some |= bool(letter.any())
        points = np.concatenate((tail, np.where(letter, points, np.uint32(0)), np.zeros(int(lo + CHARS >= len(text)), np.uint32)))
        points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]  # one gap between words
        known = len(tail) if lo else 0  # n-grams within the tail were counted with the block before
        h, grams = np.zeros(len(points), np.uint32), []
        for n in range(1, GRAMS + 1):
            if len(points) < n:
                break
            h = (h[: len(points) - n + 1] * np.uint32(0x01000193)) ^ (points[n - 1 :] * np.uint32(0x9E3779B1))
            mixed = h * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            grams.append((mixed[max(0, known - n + 1) :] + np.uint32(n * 0x3C6EF)) & np.uint32(FEATURES - 1))
        total += np.bincount(np.concatenate(grams), minlength=FEATURES)
        tail = points[1 - GRAMS :]
    places = np.flatnonzero(total) if some else np.zeros(0, np.int64)
    return places, total[places]


def held_out(doc: int | None) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % FOLDS == 0


def weighted(places: np.ndarray, numbers: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length."""
    v = (1 + np.log(numbers)) * idf[places]
    return v / max(float(np.linalg.norm(v)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_leader(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, k: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, passes: int = PASSES) -> np.ndarray:
    """Weights (FEATURES + 1, k), the last row the biases, by follow-the-regularised-leader over rows (places, values)."""
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
    penalty = np.full((FEATURES + 1, 1), l1)
    penalty[-1] = 0  # biases are not made sparse

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= penalty[at], 0, -(z[at] - np.sign(z[at]) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(11)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], FEATURES), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label[i]] -= 1
            g = x[:, None] * p
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(FEATURES + 1))


def fit_temperature(scores: np.ndarray, label: np.ndarray) -> float:
    """The temperature that makes the labels most likely, by golden section over its logarithm."""
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.mean(np.log(softmax(scores / np.exp(t))[np.arange(len(label)), label] + 1e-300)))

    lo, hi, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    """What prediction needs: languages, inverse document frequencies, weights and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights.astype(np.float32), temperature

    def __call__(self, text: str | None) -> tuple[str, float]:
        places, numbers = counts(text or "")
        if not len(places) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax((weighted(places, numbers, self.idf) @ self.weights[places] + self.weights[-1]) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def learnable(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from."""
    return docs.where((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS != 0) & F.col("lang").isNotNull())


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of each place: in how many documents it occurs, over all of docs; and the number of documents with a letter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(letters)
        df, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                places, _ = counts(text or "")
                df[places] += 1
                n += len(places) > 0
        df = np.append(df, n)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some], pa.int64())], ["place", "n"])

    # At most FEATURES + 1 rows come to the driver.
    out = np.zeros(FEATURES + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out[:-1], int(out[-1])


def sample(docs: DataFrame, per_lang: int = PER_LANG, most: int = TRAIN_DOCS) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(lang, hash, places, numbers) of at most ``most`` documents: in turn from each language the one of the next smallest hash."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().withColumn("rank", rank).where(F.col("rank") <= per_lang).orderBy("rank", "h", "lang").limit(most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counts(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("h"), *(pa.array([f[i].astype("<i4").tobytes() for f in found], pa.binary()) for i in (0, 1))], ["doc_id", "lang", "h", "places", "numbers"])

    # Broadcast: at most ``most`` rows of three values. A document's n-grams are at most FEATURES pairs of numbers; of repeated rows one is taken.
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen.drop("rank")), ["doc_id", "lang"]).select("doc_id", "lang", "h", "text").mapInArrow(run, "doc_id long, lang string, h long, places binary, numbers binary")
    one = rows.groupBy("doc_id", "lang").agg(F.first("h").alias("h"), F.min(F.struct("places", "numbers")).alias("x")).select("lang", "h", "x.*").collect()
    return sorted(((r["lang"], r["h"], np.frombuffer(r["places"], "<i4"), np.frombuffer(r["numbers"], "<i4")) for r in one if r["places"]), key=lambda r: (r[1], r[0]))


def fit(docs: DataFrame) -> Model:
    """The model of docs (doc_id, text, lang), learned from the documents that are not held out."""
    own = learnable(docs)
    df, n = document_frequencies(own)
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = sample(own)
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], idf, np.zeros((FEATURES + 1, 0)), 1.0)
    label = np.array([langs.index(r[0]) for r in rows])
    x = [(places, weighted(places, numbers, idf)) for _, _, places, numbers in rows]
    seen: dict[str, int] = {}
    kept = np.zeros(len(rows), bool)  # every fifth of a language sets the temperature
    for i, r in enumerate(rows):
        seen[r[0]] = seen.get(r[0], 0) + 1
        kept[i] = seen[r[0]] % 5 == 0
    w = fit_leader([v for v, k in zip(x, kept) if not k], label[~kept], len(langs))
    scores = np.array([v @ w[at] + w[-1] for (at, v), k in zip(x, kept) if k]).reshape(-1, len(langs))
    return Model(langs, idf, w, fit_temperature(scores, label[kept]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES rows of a number for each learned language, of which the sample bounds the number

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(letters)
        for b in batches:
            found = [shared.value(t) for t in b.column("text").to_pylist()]
            lang, score = zip(*found) if found else ((), ())
            ids = b.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array([held_out(d) for d in ids.to_pylist()], pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
