"""The registry of similarity metrics, and compare(): one shared pass per kind of input they need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, linalg
from . import knn, pairs
from .moments import Moments, moments_by_key, paired_moments


def _same_width(m: Moments) -> None:
    if m.g11.shape != m.g22.shape:
        raise ValueError("both sides must have the same number of dimensions")


def cka(m: Moments) -> float:
    c11, c22, c12 = m.centred()
    denominator = np.linalg.norm(c11) * np.linalg.norm(c22)
    return float((c12**2).sum() / denominator) if denominator >= linalg.TINY else 0.0


def mmd_linear(m: Moments) -> float:
    _same_width(m)
    return float(np.linalg.norm(m.mean1 - m.mean2))


def mmd_polynomial(m: Moments) -> float:
    _same_width(m)
    s1, s2, g1, g2, _ = m.raw()
    value = (2 * s1 @ s1 + (g1**2).sum() + 2 * s2 @ s2 + (g2**2).sum() - 2 * (2 * s1 @ s2 + (g1 * g2).sum())) / m.n**2
    return float(np.sqrt(max(value, 0.0)))


def procrustes(m: Moments) -> float:
    _same_width(m)
    c11, c22, c12 = m.centred()
    a, b = np.sqrt(max(np.trace(c11), 0)), np.sqrt(max(np.trace(c22), 0))
    if a < linalg.TINY or b < linalg.TINY:
        return 0.0
    return float(np.sqrt(max(2 - 2 * np.linalg.svd(c12 / (a * b), compute_uv=False).sum(), 0.0)))


def frechet(m: Moments) -> float:
    c11, c22, _ = m.centred()
    d = max(len(c11), len(c22))
    wide = lambda a: np.pad(a, [(0, d - len(a))] * a.ndim)
    s1, s2 = wide(c11) / (m.n - 1), wide(c22) / (m.n - 1)
    gap = wide(m.mean1) - wide(m.mean2)
    root = linalg.sym_power(s1, 0.5)
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ s2 @ root), 0)).sum()
    return float(np.sqrt(max(gap @ gap + np.trace(s1) + np.trace(s2) - 2 * cross, 0.0)))


def svcca(m: Moments, threshold: float = 0.99) -> float:
    r, _ = linalg.canonical(*m.centred(), m.n, threshold)
    return float(r.mean()) if len(r) else 0.0


def pwcca(m: Moments, threshold: float = 0.99) -> float:
    r, w = linalg.canonical(*m.centred(), m.n, threshold)
    if not len(r):
        return 0.0
    if w.sum() < linalg.TINY:
        return float(r.mean())
    w, k = w / w.sum(), min(len(r), len(w))
    return float((r[:k] * w[:k]).sum())


def tucker(m: Moments) -> float:
    _same_width(m)
    _, _, g1, g2, g12 = m.raw()
    denominator = np.sqrt(np.diag(g1) * np.diag(g2))
    return float(np.where(denominator < linalg.TINY, 0, np.abs(np.diag(g12)) / np.maximum(denominator, linalg.TINY)).mean())


def eigenspectrum(m: Moments, normalize: bool = True) -> float:
    c11, c22, _ = m.centred()
    d = max(len(c11), len(c22))
    e = [np.pad(np.maximum(np.sort(np.linalg.eigvalsh(c / (m.n - 1)))[::-1], 0), (0, d - len(c))) for c in (c11, c22)]
    if normalize:
        e = [x / x.sum() if x.sum() > linalg.TINY else x for x in e]
    return float(np.linalg.norm(e[0] - e[1]))


def riemannian(m: Moments, metric: str = "log_euclidean") -> float:
    _same_width(m)
    c11, c22, _ = m.centred()
    s1, s2 = (c / (m.n - 1) + 1e-6 * np.eye(len(c)) for c in (c11, c22))
    if metric == "log_euclidean":
        return float(np.linalg.norm(linalg.sym_log(s1) - linalg.sym_log(s2)))
    if metric != "affine_invariant":
        raise ValueError(f"unknown metric {metric}")
    half = linalg.sym_power(s1, -0.5, 1e-6)
    return float(np.linalg.norm(linalg.sym_log(half @ s2 @ half)))


def _gaussians(m: Moments):
    _same_width(m)
    c11, c22, _ = m.centred()
    eye = 1e-6 * np.eye(len(c11))
    return m.mean1, c11 / (m.n - 1) + eye, m.mean2, c22 / (m.n - 1) + eye


def kl_divergence(m: Moments) -> float:
    return linalg.gaussian_kl(*_gaussians(m))


def js_divergence(m: Moments) -> float:
    """Mean divergence from the Gaussian with the mixture's moments; not bounded by ln 2."""
    m1, s1, m2, s2 = _gaussians(m)
    mid = (m1 + m2) / 2
    s = (s1 + s2) / 2 + (np.outer(m1 - mid, m1 - mid) + np.outer(m2 - mid, m2 - mid)) / 2
    return (linalg.gaussian_kl(m1, s1, mid, s) + linalg.gaussian_kl(m2, s2, mid, s)) / 2


def linear_r2(m: Moments, alpha: float = 1.0) -> float:
    c11, c22, c12 = m.centred()
    w = linalg.ridge(c11, c12, alpha)
    residual = np.diag(c22) - 2 * (w * c12).sum(0) + np.einsum("ij,ik,kj->j", w, c11, w)
    return float(linalg.r2_columns(residual, np.diag(c22)).mean())


def fold_r2(total: Moments, fold: Moments, alpha: float) -> float:
    """R2 on a fold of the ridge fitted to the rest."""
    train = total - fold
    c11, _, c12 = train.centred()
    w = linalg.ridge(c11, c12, alpha)
    b = train.mean2 - train.mean1 @ w
    s1, s2, g11, g22, g12 = fold.raw()
    n = fold.n
    residual = np.diag(g22) - 2 * (w * g12).sum(0) - 2 * b * s2 + np.einsum("ij,ik,kj->j", w, g11, w) + 2 * b * (s1 @ w) + n * b * b
    return float(linalg.r2_columns(residual, np.diag(fold.centred()[1])).mean())


def contiguous_fold(position, n: int, k: int):
    """Fold of a 0-based position when n rows are cut into k runs, the first n % k one longer."""
    long, short = n // k + 1, n // k
    edge = (n % k) * long
    return F.when(position < edge, F.floor(position / long)).otherwise(n % k + F.floor((position - edge) / short)).cast("int")


def numbered(df: DataFrame, order: str, out: str = "_pos") -> DataFrame:
    """Adds 0-based places in the order of a unique column: ranges, places inside each, and the counts before."""
    from pyspark.sql.window import Window

    parts = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_p", F.spark_partition_id()).persist()
    before = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return parts.withColumn("_in", inside).join(F.broadcast(before.select("_p", "_base")), "_p").withColumn(out, F.col("_base") + F.col("_in")).drop("_p", "_base", "_in")


def linear_r2_cv(df: DataFrame, row_id: str, z1: str, z2: str, cv: int, alpha: float = 1.0) -> float:
    rows = numbered(df.select(row_id, z1, z2), row_id)
    rows = rows.withColumn("_fold", contiguous_fold(F.col("_pos"), rows.count(), cv))
    folds = moments_by_key(rows, z1, z2, "_fold")
    total = None
    for f in folds.values():
        total = f if total is None else total + f
    return float(np.mean([fold_r2(total, folds[k], alpha) for k in sorted(folds)]))


def swapped(m: Moments) -> Moments:
    return Moments(m.n, m.shift2, m.shift1, m.s2, m.s1, m.g22, m.g11, m.g12.T)


def bidirectional_r2(m: Moments, alpha: float = 1.0) -> float:
    return (linear_r2(m, alpha) + linear_r2(swapped(m), alpha)) / 2


def cosine_similarity(df: DataFrame, z1: str, z2: str) -> float:
    return df.agg(F.avg(arrays.cosine(arrays.doubles(F.col(z1)), arrays.doubles(F.col(z2)))).alias("c")).first().c


@dataclass
class Metric:
    needs: str
    run: Callable
    higher_is_closer: bool = True


def _cka(m: Moments, df=None, ids=None, kernel: str = "linear", gamma: float | None = None) -> float:
    if kernel == "linear":
        return cka(m)
    if kernel != "rbf":
        raise ValueError(f"unknown kernel {kernel}")
    return pairs.cka_rbf(df, ids, "z1", "z2", gamma)


def _mmd(m: Moments, df=None, ids=None, kernel: str = "rbf", gamma: float | None = None) -> float:
    _same_width(m)
    if kernel == "linear":
        return mmd_linear(m)
    if kernel == "polynomial":
        return mmd_polynomial(m)
    if kernel != "rbf":
        raise ValueError(f"unknown kernel {kernel}")
    return pairs.mmd_rbf(df, ids, "z1", "z2", gamma)


def _linear_r2(m: Moments, df=None, ids=None, alpha: float = 1.0, cv: int | None = None) -> float:
    return linear_r2(m, alpha) if cv is None else linear_r2_cv(df, ids, "z1", "z2", cv, alpha)


def _mutual(m, df, ids, k: int = 3) -> float:
    return pairs.mutual_information(df, ids, "z1", "z2", k)


def _rsa(m, df, ids, method: str = "spearman", metric: str = "cosine") -> float:
    return pairs.rsa(df, ids, "z1", "z2", method, metric).first().correlation


def _graphs(df: DataFrame, ids: str, k: int, truncate: float) -> tuple[DataFrame, DataFrame, int]:
    k = knn.effective_k(df.count(), k)
    if truncate < 100:
        df = knn.truncate_outliers(knn.truncate_outliers(df, "z1", truncate), "z2", truncate)
    return knn.knn_edges(df, ids, "z1", k).persist(), knn.knn_edges(df, ids, "z2", k).persist(), k


def _mknn(m, df, ids, k: int = 10, truncate_percentile: float = 100) -> float:
    a, b, k = _graphs(df, ids, k, truncate_percentile)
    found = knn.mknn_from_edges(a, b, k).first().mknn
    a.unpersist(), b.unpersist()
    return found


def _jaccard(m, df, ids, k: int = 10) -> float:
    a, b, k = _graphs(df, ids, k, 100)
    found = knn.jaccard_from_edges(a, b, k).first().jaccard
    a.unpersist(), b.unpersist()
    return found


def _moments_only(f: Callable) -> Callable:
    return lambda m, df=None, ids=None, **kw: f(m, **kw)


REGISTRY: dict[str, Metric] = {
    "cka": Metric("moments", _cka),
    "mmd": Metric("pairs", _mmd, False),
    "procrustes": Metric("moments", _moments_only(procrustes), False),
    "cosine_similarity": Metric("rows", lambda m, df, ids: cosine_similarity(df, "z1", "z2")),
    "frechet": Metric("moments", _moments_only(frechet), False),
    "svcca": Metric("moments", _moments_only(svcca)),
    "pwcca": Metric("moments", _moments_only(pwcca)),
    "tucker_congruence": Metric("moments", _moments_only(tucker)),
    "eigenspectrum": Metric("moments", _moments_only(eigenspectrum), False),
    "riemannian": Metric("moments", _moments_only(riemannian), False),
    "kl_divergence": Metric("moments", _moments_only(kl_divergence), False),
    "js_divergence": Metric("moments", _moments_only(js_divergence), False),
    "mutual_information": Metric("pairs", _mutual),
    "mknn": Metric("edges", _mknn),
    "jaccard": Metric("edges", _jaccard),
    "rsa": Metric("pairs", _rsa),
    "linear_r2": Metric("moments", _linear_r2),
}


def list_metrics() -> list[str]:
    return list(REGISTRY)


def compare(df: DataFrame, row_id: str, z1: str, z2: str, metrics: list[str] | None = None, **params) -> DataFrame:
    """(metric, value, error): a metric that fails has value null and says why. params: metric__parameter=value."""
    names = list_metrics() if metrics is None or [x.lower() for x in metrics] == ["all"] else list(metrics)
    if unknown := [x for x in names if x not in REGISTRY]:
        raise ValueError(f"unknown metrics {unknown}")
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(z1).cast("array<double>").alias("z1"), F.col(z2).cast("array<double>").alias("z2")).where("z1 is not null and z2 is not null").persist()
    try:
        m = paired_moments(rows)
        out = []
        for name in names:
            own = {k.split("__", 1)[1]: v for k, v in params.items() if k.startswith(f"{name}__")}
            try:
                value = REGISTRY[name].run(m, rows, "row_id", **own)
                out.append((name, None if value is None or np.isnan(value) else float(value), None))
            except Exception as e:  # noqa: BLE001  a failed metric is part of the result
                out.append((name, None, f"{type(e).__name__}: {e}"[:500]))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(out, "metric string, value double, error string")
