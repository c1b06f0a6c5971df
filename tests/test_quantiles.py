"""Exact percentiles, digamma and block sums against numpy, with nulls, ties, keys and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embralign.functions import arrays
from embralign.functions.linalg import digamma
from embralign.operators import knn, pairs, probes
from embralign.operators.quantiles import percentile_list, percentiles

QS = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize("ties", [False, True])
def test_percentiles(spark, ties):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=700), 1 if ties else 9)
    rows = [(["a", "b", None][i % 3], float(x)) for i, x in enumerate(v)] + [("a", None), ("c", None), ("d", 2.0)]
    got = percentiles(table(spark, rows), "v", QS, ("k",))
    assert set(got) == {("a",), ("b",), (None,), ("d",)}
    for (k,), q in got.items():
        own = [x for j, x in rows if j == k and x is not None]
        assert np.allclose(q, np.quantile(own, QS), rtol=1e-12)
    every = [x for _, x in rows if x is not None]
    assert np.allclose(percentile_list(table(spark, rows), "v", QS), np.quantile(every, QS), rtol=1e-12)


def test_without_values(spark):
    empty = table(spark, [("a", None)])
    assert percentile_list(empty, "v", QS) is None
    assert percentiles(empty.limit(0), "v", QS, ("k",)) == {}
    assert probes.clean(empty, "v").count() == probes.winsorise(empty, "v").count() == 0
    assert probes.joint_clip(empty, ["v"]).count() == 0


def test_hot_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 1.0).otherwise(F.col("id") / 1000).alias("v"))
    v = [r.v for r in df.collect()]
    assert np.allclose(percentile_list(df, "v", QS), np.quantile(v, QS), rtol=1e-12)


def test_digamma(spark):
    n = [1, 2, 3, 9, 10, 57, 1000, 10**6]
    want = [float((1.0 / np.arange(1, x)).sum() - np.euler_gamma) for x in n]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(n)], "i int, n long").select("i", arrays.digamma(F.col("n")).alias("x")).orderBy("i").collect()]
    assert np.allclose(got, want, atol=1e-11) and np.allclose([digamma(x) for x in n], want, atol=1e-11)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(150, 5)), rng.normal(size=(150, 3))
    return a, b, spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i long, a array<double>, b array<double>")


def _distances(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return 1 - (u @ u.T)[np.triu_indices(len(x), 1)]


def test_pair_sums(spark, vectors, monkeypatch):
    a, b, df = vectors
    want, n = np.corrcoef(_distances(a), _distances(b))[0, 1], np.histogram(1 - _distances(a), np.linspace(-1, 1, 21))[0]
    for limit in (pairs.against_all, lambda *x, **k: pairs_grid(*x, **k)):
        monkeypatch.setattr(pairs, "against_all", limit)
        assert pairs.rsa(df, "i", "a", "b", "pearson").first().correlation == pytest.approx(want, abs=1e-10)
        got = {r.bin: r.n for r in pairs.cosine_histogram(df, "i", "a", 20).collect()}
        assert [got.get(k, 0) for k in range(20)] == n.tolist()


def pairs_grid(*args, **kw):
    from embralign.operators.blocks import against_all

    return against_all(*args, **kw, broadcast_bytes=0, block_rows=40)


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], [float(i), 1.0]) for i in range(6)], "i long, a array<double>, b array<double>")
    got = pairs.rsa(df, "i", "a", "b", "pearson", "euclidean").first().correlation
    assert got is None or np.isnan(got)


def test_truncation(spark):
    df = spark.createDataFrame([(1, [1.0, -100.0, 3.0]), (2, [None, 2.0, 4.0])], "i long, v array<double>")
    bound = np.quantile([1, 100, 3, 2, 4], 0.5)
    got = {r.i: r.v for r in knn.truncate_outliers(df.where("i = 1 or i = 2"), "v", 50).collect()}
    assert got[1] == [1.0, -bound, 3.0]
