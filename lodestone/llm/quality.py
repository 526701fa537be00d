"""Quality rules: counts of whole texts, and a calibrated logistic regression on hashed n-grams.

Features are the shares of hashed words, word pairs and character trigrams
(three code points) of a text, each kind in the same table of 2^18 weights. The
model is trained by the driver on a bounded sample of labelled rows, calibrated
on the part held out, and sent to the executors: one table of fixed size. Texts
are scored in Arrow batches with array operations only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .shared import ship

BITS = 18
#: Labelled rows that the model is trained and calibrated on at most: those with the smallest hash of their id.
SAMPLE = 3000
#: Documents with a smaller calibrated probability of good quality are rejected.
THRESHOLD = 0.2
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SCALE, _ROUNDS, _RATE, _DECAY = 20.0, 80, 0.3, 1e-5

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_SHIFT = np.uint64(64 - BITS)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -40, 40)))


def _ngrams(buf: np.ndarray, offs: np.ndarray, place: np.ndarray, hashes: np.ndarray):
    """For words, pairs and trigrams: the feature of each, the first of each document, and how many it has."""
    n = place[1:] - place[:-1]
    yield (hashes >> _SHIFT).astype(np.int32), place[:-1], n
    pairs = T.mix(hashes[:-1] * np.uint64(31) + hashes[1:]) if len(hashes) else hashes
    yield (pairs >> _SHIFT).astype(np.int32), place[:-1], np.maximum(n - 1, 0)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum(T.chars(buf))])[offs]
    # A code point has 21 bits.
    three = T.mix(points[:-2] | points[1:-1] << np.uint64(21) | points[2:] << np.uint64(42)) if len(points) > 2 else points[:0]
    yield (three >> _SHIFT).astype(np.int32), begin[:-1], np.maximum(begin[1:] - begin[:-1] - 2, 0)


def _sums(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    first = np.minimum(first, len(values))
    return sums[np.minimum(first + n, len(values))] - sums[first]


def _repeats(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Words of each document in 3-word windows that occur there twice or more."""
    n, words = place[1:] - place[:-1], len(h)
    if words < 3:
        return np.zeros(len(n), np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    inside = doc[2:] == doc[:-2]
    key = T.mix(T.mix(T.mix(h[:-2]) + h[1:-1]) + h[2:] + doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    whole = np.flatnonzero(inside)  # windows that go on in the next document are none
    order = whole[np.argsort(key[whole], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    hit = np.zeros(words, bool)
    for k in range(3):
        hit[k : words - 2 + k] |= twice
    return T.per_doc(hit, place)


def _dup_lines(buf: np.ndarray, offs: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Lines of each document with a word that equal an earlier line of it."""
    starts, ends, place = T.lines(buf, offs)
    full = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    doc = np.repeat(np.arange(len(offs) - 1), place[1:] - place[:-1])
    key = T.mix(T.hashes(buf, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order][1:] == key[order][:-1]
    return T.per_doc(later & full, place)


def measure(texts: pa.Array, model: Model | None) -> dict[str, np.ndarray]:
    """The counts of each text, and its probability of good quality (1 without a model)."""
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "p_quality")}
    for _, _, buf, offs in T.chunks(texts):
        starts, ends, place = T.words(buf, offs, T.PLAIN_WORDS)
        h = T.hashes(buf, starts, ends)
        out["n_words"].append(place[1:] - place[:-1])
        out["word_chars"].append(T.per_doc(T.chars(buf) & T.PLAIN_WORDS[buf], offs))
        out["n_symbols"].append(T.per_doc(SYMBOLS[buf], offs))
        out["n_dup_lines"].append(_dup_lines(buf, offs, starts))
        out["n_repeat_words"].append(_repeats(h, place))
        score = np.zeros(len(offs) - 1)
        if model:
            score += model.bias
            for feature, first, n in _ngrams(buf, offs, place, h):
                score += _SCALE * _sums(model.weights[feature], first, n) / np.maximum(n, 1)
        out["p_quality"].append(model.probability(score) if model else score + 1)
    return {k: np.concatenate(v) if v else np.zeros(0, np.float64 if k == "p_quality" else np.int64) for k, v in out.items()}


def _sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's features and their values."""
    at, value = [np.zeros(0, np.int32)], [np.zeros(0)]
    for _, _, buf, offs in T.chunks(pa.array([text])):
        starts, ends, place = T.words(buf, offs, T.PLAIN_WORDS)
        for feature, first, n in _ngrams(buf, offs, place, T.hashes(buf, starts, ends)):
            own = feature[first[0] : first[0] + n[0]]
            if len(own):
                u, c = np.unique(own, return_counts=True)
                at.append(u)
                value.append(_SCALE * c / n[0])
    u, inverse = np.unique(np.concatenate(at), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate(value), minlength=len(u))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model | None:
    """Logistic regression by Adam on three rows of four, calibrated by Platt's method on the others. None if a class is missing."""
    if not len(labels) or len(set(labels.tolist())) < 2:
        return None
    held = np.arange(len(rows)) % 4 == 3
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False

    def matrix(which):
        own = [rows[i] for i in np.flatnonzero(which)]
        return np.concatenate([r[0] for r in own] or [np.zeros(0, np.int32)]), np.concatenate([r[1] for r in own] or [np.zeros(0)]), np.concatenate([[0], np.cumsum([len(r[0]) for r in own])]).astype(np.int64)

    at, value, place = matrix(~held)
    used, at = np.unique(at, return_inverse=True)
    y = labels[~held].astype(float)
    balance = np.where(y > 0, len(y) / 2 / max(y.sum(), 1), len(y) / 2 / max((1 - y).sum(), 1))
    owner = np.repeat(np.arange(len(y)), place[1:] - place[:-1])
    w, m, v, bias = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0.0
    for k in range(1, _ROUNDS + 1):
        score = np.bincount(owner, value * w[at], minlength=len(y)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - y) * balance / len(y)
        g = np.append(np.bincount(at, value * error[owner], minlength=len(used)), error.sum()) + _DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= _RATE * (1 - k / (_ROUNDS + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    weights, bias = np.zeros(1 << BITS, np.float32), float(w[-1])
    weights[used] = w[:-1]
    slope, shift = 1.0, 0.0
    if held.any():
        a, x, p = matrix(held)
        score = np.bincount(np.repeat(np.arange(len(p) - 1), p[1:] - p[:-1]), x * weights[a], minlength=len(p) - 1) + bias
        slope, shift = calibrate(score, labels[held].astype(float))
    return Model(weights, bias, slope, shift)


def calibrate(score: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, shift) by Platt's method: a logistic curve through smoothed labels, by Newton's steps, halved until the loss falls."""
    positive = labels.sum()
    t = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    # Scores are scaled first, so that no step begins where the curve is flat.
    middle, scale = score.mean(), max(score.std(), 1e-9)
    x = (score - middle) / scale

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((np.logaddexp(0, z) - t * z).sum() + 5e-4 * (a * a + b * b))

    a, b = 0.0, float(np.log((positive + 1) / (len(labels) - positive + 1)))
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        r = q * (1 - q)
        grad = np.array([((q - t) * x).sum() + 1e-3 * a, (q - t).sum() + 1e-3 * b])
        hess = np.array([[(r * x * x).sum(), (r * x).sum()], [(r * x).sum(), r.sum()]]) + 1e-3 * np.eye(2)
        step, now, size = np.linalg.solve(hess, grad), loss(a, b), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * float(step[0]), b - size * float(step[1])
        if abs(step).max() < 1e-8:
            break
    return a / scale, b - a * middle / scale


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The model of labelled rows (label 0 or 1; others are left out), at most `sample` of them. None for too few."""
    ship(docs.sparkSession)
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    chosen = chosen.orderBy(F.xxhash64("k"), "k", "y").limit(sample)
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select("k", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at, value = _sparse(b.column(2)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([at.astype(np.int32).tobytes()]), pa.array([value.astype(np.float32).tobytes()])], ["k", "y", "at", "value"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.mapInArrow(run, f"k {kind}, y int, at binary, value binary").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (str(got["k"][i].as_py()), got["y"][i].as_py(), len(got["at"][i].as_py())))
    sparse = [(np.frombuffer(got["at"][i].as_py(), np.int32), np.frombuffer(got["value"][i].as_py(), np.float32).astype(float)) for i in order]
    return fit(sparse, np.array([got["y"][i].as_py() for i in order]))


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a column `quality`: the counts, p_quality, base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words in
    repeated 3-word windows. kept: not base_failed, and p_quality reaches the
    threshold (without a model, all reach it). Null and empty texts have no
    words and fail. An input column of that name is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("quality")
    sent, names = spark.sparkContext.broadcast(model), docs.columns
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "p_quality", "base_failed", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index(text)
        for b in batches:
            got = measure(b.column(place), sent.value)
            got["base_failed"] = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
            got["kept"] = ~got["base_failed"] & (got["p_quality"] >= threshold)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays([pa.array(got[k]) for k in fields], fields)], [*names, "quality"])

    kinds = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,p_quality:double,base_failed:boolean,kept:boolean>"
    return docs.mapInArrow(run, docs.withColumn("quality", F.lit(None).cast(kinds)).schema)
