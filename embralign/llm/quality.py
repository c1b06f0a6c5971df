"""Document quality by nearest-neighbour voting in a latent semantic space.

A text is described by log-scaled counts of hashed word shapes and byte runs and by how repetitive,
capital and symbolic it is, weighted by rarity and projected to a few latent dimensions (truncated SVD
of the labelled sample). The labelled vectors are broadcast (their number is bounded by a parameter);
every document's cosines with all of them are computed exactly, in blocks, and the nearest vote,
weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import read_table, ship
from ._sample import bounded, held_out
from ._text import BASE, SPACED, U, as_bytes, hash_words, text_slices

HASHED, STYLE, STEPS = 1536, 8, 12
DIMENSIONS = HASHED + STYLE * (STEPS + 1)

#: Upper-case and lower-case letters, digits, white space, letters beyond ASCII; other bytes stand for themselves.
_shape = np.arange(256, dtype=np.uint8)
_shape[0x41:0x5B] = 0x41
_shape[0x61:0x7B] = 0x61
_shape[0x80:] = 0x61
_shape[0x30:0x3A] = 0x30
_shape[[0x09, 0x0B, 0x0C, 0x0D]] = 0x20


def _text_features(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.zeros(DIMENSIONS, np.float32)
    n, w = len(data), len(words)
    if not w:
        return out
    for x in range(0, n, 1 << 20):
        code = _shape[data[x : x + (1 << 20) + 3]].astype(U)
        if len(code) > 3:
            h = (code[:-3] << U(24)) | (code[1:-2] << U(16)) | (code[2:-1] << U(8)) | code[3:]
            out[:512] += np.bincount((h * U(BASE) >> U(40)).astype(np.int64) % 512, minlength=512)
    distinct, times = np.unique(words, return_counts=True)
    out[512:HASHED] = np.bincount((distinct >> U(20)).astype(np.int64) % (HASHED - 512), weights=times, minlength=HASHED - 512)
    out[:HASHED] = np.log1p(out[:HASHED])
    out[:512] /= max(np.linalg.norm(out[:512]), 1e-9)
    out[512:HASHED] /= max(np.linalg.norm(out[512:HASHED]), 1e-9)
    byte = np.bincount(data, minlength=256)
    letters = byte[0x41:0x5B].sum() + byte[0x61:0x7B].sum() + byte[0x80:].sum()
    visible = max(1, n - byte[0x20] - byte[0x0A])
    share = (
        len(distinct) / w, times.max() / w, byte[0x41:0x5B].sum() / max(1, letters), (visible - letters) / visible,
        (words[1:] == words[:-1]).mean() if w > 1 else 0.0, min(1.0, np.log1p(w) / 10), min(1.0, n / w / 20), min(1.0, byte[0x0A] / w * 5),
    )
    for k, v in enumerate(share):
        at = HASHED + k * (STEPS + 1)
        place = min(max(float(v), 0.0), 1.0) * STEPS
        low = min(int(place), STEPS - 1)
        out[at + low], out[at + low + 1] = 1 - (place - low), place - low
    return out


def features(column: pa.Array) -> np.ndarray:
    data, offsets = as_bytes(column)
    rows = []
    for a, b in text_slices(offsets):
        part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        words, counts, _ = hash_words(part, offs, SPACED)
        at = 0
        for i, c in enumerate(counts.tolist()):
            rows.append(_text_features(part[offs[i] : offs[i + 1]], words[at : at + c]))
            at += c
    return np.stack(rows) if rows else np.zeros((0, DIMENSIONS), np.float32)


class Neighbours:
    """Labelled latent vectors, and the projection that makes one of a text's features."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int = 48, seed: int = 7):
        rare = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
        self.weight = (rare * np.where(np.arange(DIMENSIONS) < HASHED, 1.0, 0.5)).astype(np.float32)
        x = x * self.weight
        rng = np.random.default_rng(seed)
        q = rng.standard_normal((DIMENSIONS, min(rank + 8, len(x)))).astype(np.float32)
        for _ in range(4):  # subspace iteration for the leading right singular vectors
            q = np.linalg.qr(x.T @ (x @ q))[0].astype(np.float32)
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        self.project = (q @ v.T[:, :rank]).astype(np.float32)
        self.vectors = self._unit(x @ self.project)
        self.labels = labels.astype(np.float32)

    @staticmethod
    def _unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, k: int) -> np.ndarray:
        """Similarity-weighted share of label 1 among the k nearest; equal similarities in the order of the labelled rows."""
        z = self._unit((x * self.weight) @ self.project)
        k = min(k, len(self.labels))
        out = np.empty(len(z))
        for a in range(0, len(z), 256):
            cosine = z[a : a + 256] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            own = np.take_along_axis(cosine, near, 1)
            edge = own.min(1, keepdims=True)
            torn = np.flatnonzero((cosine == edge).sum(1) > (own == edge).sum(1))  # some of equal similarities are in, some out
            if len(torn):
                above, ties = cosine[torn] > edge[torn], cosine[torn] == edge[torn]
                first = ties & (np.cumsum(ties, axis=1) <= k - above.sum(1, keepdims=True))
                near[torn] = np.nonzero(above | first)[1].reshape(-1, k)
            near.sort(axis=1)
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 4 + 1e-9
            out[a : a + 256] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out


def score_quality(docs: DataFrame, labelled: DataFrame, *, per_label: int = 2000, k: int = 15, threshold: float = 0.7) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, score, predicted; labelled: doc_id, text, quality (0 or 1).

    Votes come from at most about `per_label` rows of each label, those with the smallest hashes of
    doc_id. Texts without words (null, empty, blank) score 0; without any labelled rows every text scores 0.
    Extra columns are ignored; rows that repeat a doc_id score alike if their texts do.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = labelled.where("text is not null and quality is not null").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    chosen = bounded(rows.select("doc_id", "quality"), "quality", "doc_id", per_label).select("doc_id").distinct()
    sample = rows.join(F.broadcast(chosen), "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in features(batch.column("text"))], pa.binary())], names=["doc_id", "quality", "x"])

    got = sample.mapInArrow(describe, "doc_id long, quality int, x binary").collect()  # bounded
    got.sort(key=lambda r: (str(r.doc_id), r.quality, bytes(r.x)))
    model = Neighbours(np.stack([np.frombuffer(r.x, np.float32) for r in got]), np.array([r.quality for r in got])) if got else None
    shared = spark.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                x = features(batch.column("text"))
                score = np.where(x.any(1), shared.value.score(x, k), 0.0) if shared.value and len(x) else np.zeros(len(x))
                score = np.clip(score, 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score.astype(float)), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(vote, "doc_id long, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    # Only bounded sample rows need their texts: labels choose the rows first, then meet the texts.
    chosen = bounded(labels.where("doc_id is not null and quality is not null"), "quality", "doc_id", 2000).select("doc_id", "quality")
    labelled = docs.join(F.broadcast(chosen), "doc_id")
    out = score_quality(docs, labelled)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
