"""How well embeddings encode scalar properties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from . import knn, pairs
from .metrics import contiguous_fold, fold_r2, numbered
from .moments import Moments, moments_by_key, paired_moments
from .quantiles import percentile_list


def clean(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows with a finite value inside the inclusive percentiles of the finite values."""
    v = df.withColumn(value, arrays.finite(F.col(value).cast("double")))
    edge = percentile_list(v, value, [low, high])
    return v.where(F.col(value).between(*edge)) if edge else v.where(F.lit(False))


def winsorise(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, keep: Column | None = None) -> DataFrame:
    """Clips to the percentiles instead of dropping; rows that aren't finite (or fail `keep`) go."""
    v = df.withColumn(value, arrays.finite(F.col(value).cast("double"))).where(F.col(value).isNotNull() if keep is None else F.col(value).isNotNull() & keep)
    edge = percentile_list(v, value, [low, high])
    return v.withColumn(value, _within(value, edge)) if edge else v


def _within(value: str, edge: list[float]) -> Column:
    return F.greatest(F.least(F.col(value), F.lit(edge[1])), F.lit(edge[0]))


def unit(v: Column) -> Column:
    n = F.when(arrays.norm(v) < 1e-12, F.lit(1.0)).otherwise(arrays.norm(v))
    return F.transform(v, lambda x: x / n)


def principal_axes(m: Moments, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first side's mean and its k leading principal axes as columns, each with its largest component positive."""
    _, v = np.linalg.eigh(m.centred()[0])
    v = v[:, ::-1][:, :k]
    return m.mean1, v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def projected(m: Moments, mean: np.ndarray, axes: np.ndarray) -> Moments:
    """Moments with the first side projected to axes about mean."""
    c = mean - m.shift1
    s1 = (m.s1 - m.n * c) @ axes
    g11 = m.g11 - np.outer(m.s1, c) - np.outer(c, m.s1) + m.n * np.outer(c, c)
    return Moments(m.n, np.zeros(axes.shape[1]), m.shift2, s1, m.s2, axes.T @ g11 @ axes, m.g22, axes.T @ (m.g12 - np.outer(c, m.s2)))


def project(df: DataFrame, vector: str, k: int, out: str = "projected", width: int | None = None) -> DataFrame:
    """Adds the projection of each vector to the k leading principal axes about the mean, filled up with zeros to `width`.

    One pass finds the axes from moments; the second is an expression with the axes as literals, so rows stay in the JVM.
    """
    m = paired_moments(df, vector, vector)
    mean, axes = principal_axes(m, min(k, len(m.mean1)))
    centred = F.zip_with(arrays.doubles(F.col(vector)), F.lit(mean.tolist()), lambda x, y: x - y)
    parts = F.transform(F.lit(axes.T.tolist()), lambda a: arrays.dot(F.col("_centred"), a))
    fill = max(0, (width or 0) - axes.shape[1])
    return df.withColumn("_centred", centred).withColumn(out, F.concat(parts, F.array_repeat(F.lit(0.0), fill)) if fill else parts).drop("_centred")


def joint_clip(df: DataFrame, values: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows finite in all values, each clipped to the percentiles of what is left."""
    for v in values:
        df = df.withColumn(v, arrays.finite(F.col(v).cast("double")))
    df = df.dropna(subset=values)
    edges = {v: percentile_list(df, v, [low, high]) for v in values}
    return df.withColumns({v: _within(v, edge) for v, edge in edges.items() if edge})


def probe_weights(df: DataFrame, vector: str, values: list[str]) -> np.ndarray:
    """Least-squares weights (a column for each value) of vectors with an intercept, from one pass of moments."""
    m = paired_moments(df.withColumn("_y", F.array(*[F.col(v).cast("double") for v in values])), vector, "_y")
    return np.linalg.pinv(m.centred()[0]) @ m.centred()[2]


def probe_weight_cosines(df: DataFrame, vector: str, values: list[str]) -> DataFrame:
    """(value_a, value_b, cosine): cosines of the probes' weight vectors, within -1 and 1."""
    w = probe_weights(df, vector, values)
    w = w / np.maximum(np.linalg.norm(w, axis=0), 1e-12)
    c = np.clip(w.T @ w, -1, 1)
    return df.sparkSession.createDataFrame([(a, b, float(c[i, j])) for i, a in enumerate(values) for j, b in enumerate(values)], "value_a string, value_b string, cosine double")


def disparities(df: DataFrame, models: list[str]) -> DataFrame:
    """(model_a, model_b, disparity): 1-D Procrustes disparity 1 - corr^2 of all pairs of prediction columns, in one pass."""
    pairs_of = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    one = df.agg(*[(1 - F.corr(a, b) ** 2).alias(f"_{k}") for k, (a, b) in enumerate(pairs_of)])
    rows = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"_{k}").alias("disparity")) for k, (a, b) in enumerate(pairs_of)])
    return one.select(F.inline(rows))


def run_physics(df: DataFrame, row_id: str, vector: str, values: list[str], cv: int = 5, pca_components: int | None = None) -> DataFrame:
    """(property, fold, r2): the linear probe of every property; probe_summary() of it is the grand mean with its standard error."""
    out = []
    for v in values:
        got = linear_probe(df, row_id, vector, v, cv, pca_components)
        out += [(v, k, r2) for k, r2 in enumerate(got["folds"])] if got else []
    return df.sparkSession.createDataFrame(out, "property string, fold int, r2 double")


def linear_probe(df: DataFrame, row_id: str, vector: str, value: str, cv: int = 5, pca_components: int | None = None) -> dict | None:
    """Least squares on unit vectors in contiguous folds of the cleaned rows: mean, std (ddof 0) and folds of R2; None if fewer rows than folds.

    With pca_components the vectors are projected to the leading axes of each fold's training rows.
    """
    rows = clean(df.select(row_id, unit(arrays.doubles(F.col(vector))).alias("z1"), F.col(value).alias("y")), "y")
    rows = numbered(rows, row_id)
    n = rows.count()
    if n < cv:
        return None
    rows = rows.withColumn("z2", F.array("y")).withColumn("_fold", contiguous_fold(F.col("_pos"), n, cv))
    folds = moments_by_key(rows, "z1", "z2", "_fold")
    total = None
    for f in folds.values():
        total = f if total is None else total + f
    pairs_of = [(total, folds[k]) for k in sorted(folds, key=int)]
    if pca_components is not None:
        axes = [principal_axes(whole - test, pca_components) for whole, test in pairs_of]
        pairs_of = [(projected(whole, *a), projected(test, *a)) for (whole, test), a in zip(pairs_of, axes, strict=True)]
    scores = [fold_r2(whole, test, 0.0) for whole, test in pairs_of]
    return {"mean": float(np.mean(scores)), "std": float(np.std(scores)), "folds": scores}


def random_split_probe(df: DataFrame, row_id: str, vector: str, value: str, runs: int = 10, test_size: int = 2000) -> dict | None:
    """Least squares on z-scores of random train rows, R2 on test rows, for seeds 0..runs-1; None with fewer than test_size + 100 rows.

    Splits come from the driver's generator as row places and go out as a table of (place, run).
    """
    rows = numbered(winsorise(df.select(row_id, arrays.doubles(F.col(vector)).alias("z1"), F.col(value).alias("y")), "y").withColumn("z2", F.array("y")), row_id).persist()
    n = rows.count()
    if n < test_size + 100:
        return None
    tests = [(int(p), r) for r in range(runs) for p in np.random.default_rng(r).permutation(n)[:test_size]]
    split = df.sparkSession.createDataFrame(tests, "_pos long, run int")
    total = moments_by_key(rows, "z1", "z2")[None]
    folds = moments_by_key(rows.join(F.broadcast(split), "_pos"), "z1", "z2", "run", (total.shift1, total.shift2))
    rows.unpersist()
    scores = [fold_r2(total, folds[str(r)], 0.0) for r in range(runs)]
    return {"mean": float(np.mean(scores)), "std": float(np.std(scores)), "n": n}


def nonlinear_probe(df: DataFrame, vector: str, value: str, row_id: str, cv: int = 3, trees: int = 20, depth: int = 4) -> dict:
    """Gradient-boosted trees in contiguous folds, on features scaled over all rows."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    rows = numbered(clean(df.select(row_id, F.col(vector).alias("v"), F.col(value).alias("y")), "y"), row_id)
    held = rows.select("_pos", "y", array_to_vector(arrays.doubles(F.col("v"))).alias("raw")).persist()
    rows = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(held).transform(held)
    rows = rows.withColumn("_fold", contiguous_fold(F.col("_pos"), rows.count(), cv))
    scores = []
    for k in range(cv):
        model = GBTRegressor(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, subsamplingRate=0.8, stepSize=0.1, seed=42).fit(rows.where(F.col("_fold") != k))
        got = model.transform(rows.where(F.col("_fold") == k)).agg(F.sum((F.col("y") - F.col("prediction")) ** 2).alias("r"), (F.var_pop("y") * F.count("y")).alias("t")).first()
        scores.append(1 - got.r / got.t)
    held.unpersist()
    return {"mean": float(np.mean(scores)), "std": float(np.std(scores)), "folds": scores}


def probe_summary(folds: DataFrame) -> DataFrame:
    """(property, r2) per fold -> grand mean over properties and its propagated standard error sqrt(sum s^2 / F) / K."""
    each = folds.groupBy("property").agg(F.avg("r2").alias("m"), F.var_samp("r2").alias("v"), F.count("r2").alias("f"))
    return each.agg(F.avg("m").alias("grand_mean"), (F.sqrt(F.sum(F.col("v") / F.col("f"))) / F.count("*")).alias("standard_error"), F.count("*").alias("properties"))


def embedding_property_correlation(df: DataFrame, row_id: str, vector: str, value: str, digits: int | None = None) -> DataFrame:
    """Spearman correlation of pairwise cosine distances with absolute differences of the property."""
    rows = df.withColumn("_y", F.array(F.col(value).cast("double")))
    return pairs.rank_correlation(rows, row_id, vector, "_y", ("cosine", "cityblock"), digits)


def neighbour_set_overlap(df: DataFrame, row_id: str, vector: str, values: list[str], k: int = 10, scale: bool = False) -> DataFrame:
    """Shared neighbours in embedding space and in (z-scored) property space, as a share of k."""
    y = [F.col(v).cast("double") for v in values]
    if scale:
        stats = df.agg(*[x for v in values for x in (F.avg(v).alias(f"_m_{v}"), F.stddev_pop(v).alias(f"_s_{v}"))])
        df = df.crossJoin(F.broadcast(stats))
        y = [(F.col(v) - F.col(f"_m_{v}")) / F.when(F.col(f"_s_{v}") < 1e-12, 1.0).otherwise(F.col(f"_s_{v}")) for v in values]
    rows = df.select(row_id, vector, F.array(*y).alias("_y"))
    return knn.mknn_from_edges(knn.knn_edges(rows, row_id, vector, k), knn.knn_edges(rows, row_id, "_y", k, "euclidean"), k).withColumnRenamed("mknn", "overlap")
