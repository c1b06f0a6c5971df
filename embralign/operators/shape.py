"""Shape statistics of one embedding, and permutation calibration of a pair."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from . import knn
from .moments import paired_moments


def anisotropy(df: DataFrame, vector: str) -> float:
    """Mean cosine of all pairs, from the sum of unit vectors alone."""
    v = arrays.doubles(F.col(vector))
    u = paired_moments(df.select(F.transform(v, lambda x: x / arrays.norm(v)).alias("u")), "u", "u")
    s, *_ = u.raw()
    return float((s @ s - u.n) / (u.n * (u.n - 1)))


def shape_statistics(df: DataFrame, row_id: str, vector: str, k: int = 10) -> DataFrame:
    """(statistic, value): norm, anisotropy over all pairs, spectrum shape, lower median k-th neighbour distance, TwoNN dimension."""
    v = arrays.doubles(F.col(vector))
    mean_norm = df.agg(F.avg(arrays.norm(v)).alias("x")).first().x
    m = paired_moments(df, vector, vector)
    w = np.maximum(np.linalg.eigvalsh(m.centred()[0] / (m.n - 1)), 0)
    p = w / w.sum()
    edges = knn.knn_edges(df, row_id, vector, k, "euclidean").persist()
    p50 = edges.where(F.col("rank") == k).agg(F.expr("percentile_disc(0.5) within group (order by dist)").alias("x")).first().x
    out = {
        "mean_l2_norm": mean_norm,
        "anisotropy": anisotropy(df, vector),
        "participation_ratio": float(w.sum() ** 2 / (w**2).sum()),
        "top_eigval_ratio": float(w.max() / w.sum()),
        "effective_rank": float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum())),
        "knn_dist_p50": p50,
        "intrinsic_dim_two_nn": knn.two_nn_global(edges).first().dimension,
    }
    edges.unpersist()
    return df.sparkSession.createDataFrame(list(out.items()), "statistic string, value double")


def calibrated(observed: float, nulls: np.ndarray, alpha: float = 0.05, most: float = 1.0) -> dict:
    """Score above the (1 - alpha) threshold of null scores, as a share of what is left up to `most`."""
    every = np.sort(np.append(nulls, observed))
    tau = float(every[math.ceil((1 - alpha) * (len(nulls) + 1)) - 1])
    score = float(np.clip((observed - tau) / max(most - tau, 1e-30), 0, 1))
    return {"score": observed, "calibrated_score": score, "tau": tau, "p_value": float((1 + (nulls >= observed).sum()) / (len(nulls) + 1)), "null_mean": float(nulls.mean()), "null_std": float(nulls.std())}


def calibrate_cka_mknn(df: DataFrame, row_id: str, z1: str, z2: str, k: int = 10, permutations: int = 200, seed: int = 0) -> DataFrame:
    """(metric, score, calibrated_score, tau, p_value, null_mean, null_std) for linear CKA and mutual k-NN.

    Permutations run as tasks on broadcast matrices and neighbour lists; nothing but their scores comes back.
    The pair must fit an executor's memory, as a permutation needs all rows at once.
    """
    spark = df.sparkSession
    rows = df.select(F.col(row_id).alias("i"), arrays.doubles(F.col(z1)).alias("a"), arrays.doubles(F.col(z2)).alias("b")).orderBy("i").toPandas()
    a, b = np.array(rows.a.tolist()), np.array(rows.b.tolist())
    a, b, n = a - a.mean(0), b - b.mean(0), len(a)
    ids = rows.i.to_numpy()

    def lists(vector: str) -> np.ndarray:
        e = knn.knn_edges(df, row_id, vector, k).orderBy("i", "rank").toPandas()
        return np.searchsorted(ids, e.j.to_numpy()).reshape(n, -1)

    shared = spark.sparkContext.broadcast((a, b, lists(z1), lists(z2)))
    denominator = np.linalg.norm(a.T @ a) * np.linalg.norm(b.T @ b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, nx, ny = shared.value
        for batch in batches:
            out = []
            for p in batch.column("id").to_pylist():
                order = np.arange(n) if p < 0 else np.random.default_rng([seed, p]).permutation(n)
                back = np.argsort(order)
                other = back[ny[order]]
                both = (nx[:, :, None] == other[:, None, :]).any(2).sum() / nx.size
                out.append((p, float(((x.T @ y[order]) ** 2).sum() / denominator), float(both)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.float64(), pa.float64())], names=["id", "cka", "mknn"])

    got = spark.range(-1, permutations).mapInArrow(run, "id long, cka double, mknn double").toPandas().sort_values("id")
    out = [(name, *calibrated(float(got[name].iloc[0]), got[name].to_numpy()[1:]).values()) for name in ("cka", "mknn")]
    return spark.createDataFrame(out, "metric string, score double, calibrated_score double, tau double, p_value double, null_mean double, null_std double")


def cell_seed(seed: int, i: int, j: int) -> int:
    """The seed of cell (i, j) of a grid of models (fixed rule: 10,000 cells a row)."""
    return seed + 10_000 * i + j


def calibrate(df: DataFrame, row_id: str, z1: str, z2: str, similarity: Callable[[np.ndarray, np.ndarray], float], permutations: int = 1000, seed: int = 0, alpha: float = 0.05) -> dict:
    """Any similarity of two float32 matrices against permutations of the second one's rows: calibrated_score, p_value, threshold and the score.

    Permutations run as tasks; the pair must fit an executor's memory, as the similarity needs all rows at once.
    """
    spark = df.sparkSession
    rows = df.select(F.col(row_id).alias("i"), arrays.doubles(F.col(z1)).alias("a"), arrays.doubles(F.col(z2)).alias("b")).orderBy("i").toPandas()
    shared = spark.sparkContext.broadcast((np.array(rows.a.tolist(), np.float32), np.array(rows.b.tolist(), np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        for batch in batches:
            ids = batch.column("id").to_pylist()
            scores = [float(similarity(a, b if p < 0 else b[np.random.default_rng([seed, p]).permutation(len(b))])) for p in ids]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    got = spark.range(-1, permutations).mapInArrow(run, "id long, score double").toPandas().sort_values("id").score.to_numpy()
    r = calibrated(float(got[0]), got[1:], alpha)
    return {"calibrated_score": r["calibrated_score"], "p_value": r["p_value"], "threshold": r["tau"], "score": r["score"]}


def calibration_rule(nulls: DataFrame, value: str, observed: float, alpha: float = 0.05, most: float = 1.0) -> DataFrame:
    """The same rule over a table of null scores of any size: tau, calibrated_score, p_value, null_mean, null_std."""
    every = nulls.select(F.col(value).cast("double").alias("x"), F.lit(False).alias("own")).unionByName(nulls.sparkSession.createDataFrame([(float(observed), True)], "x double, own boolean"))
    null = F.when(~F.col("own"), F.col("x"))
    got = every.agg(F.expr(f"percentile_disc({1 - alpha}) within group (order by x)").alias("tau"), F.count_if(~F.col("own") & (F.col("x") >= observed)).alias("over"), F.count(null).alias("n"), F.avg(null).alias("null_mean"), F.stddev_pop(null).alias("null_std"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(float(observed)) - F.col("tau")) / F.greatest(most - F.col("tau"), F.lit(1e-30))))
    return got.select("tau", score.alias("calibrated_score"), ((1 + F.col("over")) / (F.col("n") + 1)).alias("p_value"), "null_mean", "null_std")
