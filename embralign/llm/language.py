"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; for each bit, a logistic model on hashed n-grams of the
whole text separates the languages with +1 from those with -1. A text's language is the codeword
with the smallest loss, summed over bits with weights from the bits' accuracy on rows held back; several bits can
be wrong before another codeword is nearer. A small gap to the second codeword flags ambiguity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import read_table, ship
from ._sample import bounded, held_out
from ._text import BASE, U, as_bytes, text_slices

DIMENSIONS = 2048

_letters = np.arange(256, dtype=np.uint8)
_letters[:0x80] = 0x20
_letters[0x61:0x7B] = np.arange(0x61, 0x7B)
_letters[0x41:0x5B] = np.arange(0x61, 0x7B)


def features(column: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Square roots of the shares of hashed runs of two to four bytes (letters lower-cased, all else ASCII a space)."""
    data, offsets = as_bytes(column)
    out = np.zeros((len(offsets) - 1, dimensions), np.float32)
    for a, b in text_slices(offsets, 1 << 20):
        for c in range(a, b, 256):
            d = min(b, c + 256)
            lo, hi = int(offsets[c]), int(offsets[d])
            for x in range(lo, hi, 1 << 20):  # one long text in parts that overlap by the longest run
                y = min(hi, x + (1 << 20))
                code = _letters[data[x : min(hi, y + 3)]].astype(U)
                owner = np.searchsorted(offsets[c + 1 : d + 1], np.arange(x, min(hi, y + 3)), side="right")
                h = code.copy()
                for k in range(1, 4):
                    if len(code) <= k:
                        break
                    h = h[:-1] * U(BASE) + code[k:]
                    own, n = owner[: len(h)], y - x
                    same = (own == owner[k:]) & (np.arange(len(h)) < n)
                    place = own[same] * dimensions + ((h[same] ^ (h[same] >> U(29))) * U(BASE) >> U(40)).astype(np.int64) % dimensions
                    out[c:d] += np.bincount(place, minlength=(d - c) * dimensions)[: (d - c) * dimensions].reshape(d - c, dimensions)
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def codewords(k: int) -> np.ndarray:
    """k x bits of +1 and -1: the exhaustive code for up to 6 languages, else the best of some random codes by smallest distance."""
    if k <= 6:
        bits = max(1, 2 ** (k - 1) - 1)
        return np.array([[1 - 2 * ((b + 1) >> (i - 1) & 1) if i else 1 for b in range(bits)] for i in range(k)], np.float64)
    rng, best, far = np.random.default_rng(k), None, -1
    bits = math.ceil(10 * math.log2(k))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, bits))
        split = np.abs(code.sum(0)) < k
        distance = ((bits - code @ code.T) / 2 + bits * np.eye(k)).min() if split.all() else -1
        if distance > far:
            best, far = code, distance
    return best


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.trust = languages, code, weights, trust

    def score(self, x: np.ndarray) -> np.ndarray:
        """A share of belief for each language: the softmax of the negative weighted losses."""
        f = np.hstack([x, np.ones((len(x), 1), np.float32)]) @ self.weights
        loss = np.stack([(np.logaddexp(0, -f * c) * self.trust).sum(1) for c in self.code], 1)
        e = np.exp(loss.min(1, keepdims=True) - loss)
        return e / e.sum(1, keepdims=True)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 250, l2: float = 1e-4) -> np.ndarray:
    """Weights (with a bias) of logistic models for the columns of y (+1, -1), by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    y = y.astype(np.float32)
    w = v = np.zeros((x.shape[1], y.shape[1]), np.float32)
    rate = 2.0  # rows have norm sqrt(2) with the bias, so the curvature is at most 1/2
    for k in range(steps):
        margin = y * (x @ v)
        grad = -(x.T @ (y / (1 + np.exp(np.clip(margin, -30, 30))))) / len(x) + l2 * v
        new = v - rate * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def fit(x: np.ndarray, labels: list[str], back: int = 5) -> Model:
    """A model of all rows; a bit's weight is its accuracy on every `back`-th row, by a model that didn't see those."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in labels]]
    held = np.arange(len(x)) % back == back - 1
    trust = np.ones(code.shape[1])
    if held.any():
        w = logistic(x[~held], y[~held])
        right = ((np.hstack([x[held], np.ones((held.sum(), 1), np.float32)]) @ w) * y[held] > 0).sum(0)
        trust = np.clip(2 * (right + 1) / (held.sum() + 2) - 1, 0.05, 1)
    return Model(languages, code, logistic(x, y), trust)


def identify(docs: DataFrame, labelled: DataFrame, *, per_language: int = 500, gap: float = 0.2) -> DataFrame:
    """Adds lang_pred, score and ambiguous to docs (text, ...); labelled: doc_id, text, lang.

    Learns from at most about `per_language` rows of each language, those with the smallest hashes of
    doc_id. lang_pred is `und` with score 0 for null and letterless texts, and for every text if
    nothing is labelled. Of codewords with equal losses the language first in order is taken. ambiguous: the best language's share of belief is less than `gap` above the second's.
    Columns lang_pred, score and ambiguous of docs, if any, are replaced; others pass through.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    chosen = bounded(rows.select("doc_id", "lang"), "lang", "doc_id", per_language).select("doc_id")
    sample = rows.join(F.broadcast(chosen.distinct()), "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

    got = sample.mapInArrow(describe, "doc_id long, lang string, x binary").collect()  # bounded
    got.sort(key=lambda r: (str(r.doc_id), r.lang, bytes(r.x)))
    model = fit(np.stack([np.frombuffer(r.x, np.float32) for r in got]), [r.lang for r in got]) if got else None
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "ambiguous")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                column = batch.column("text")
                letters = np.array([v is not None and any(map(str.isalpha, v)) for v in column.to_pylist()], bool)
                if m is None:
                    pred, score, unsure = ["und"] * len(letters), np.zeros(len(letters)), letters & False
                else:
                    p = m.score(features(column))
                    best = p.argmax(1)
                    score = np.where(letters, p.max(1), 0.0)
                    second = np.sort(p, 1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
                    unsure = letters & (p.max(1) - second < gap)
                    pred = [m.languages[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score.astype(float)), pa.array(unsure)], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.mapInArrow(predict, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), docs.where(~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
