"""Pair work in blocks, ranges and product forms gives what the plain forms give, on ties, far values and bounded memory."""

import numpy as np
import pandas as pd
import pytest

from embralign.operators import blocks, knn, pairs, shape

RNG = np.random.default_rng(7)
# ties, exact copies, and rows that are far from the others
X = np.round(np.concatenate([RNG.standard_normal((60, 5)), np.zeros((8, 5)), 1e6 + RNG.standard_normal((12, 5))]), 1)
Y = np.round(X[:, :4] + RNG.standard_normal((80, 4)), 1)


def table(spark, x, y):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i long, z1 array<double>, z2 array<double>")


def plain_edges(x, k, metric):
    d = knn.distances(x, x, metric)
    return [(i, j, d[i, j]) for i in range(len(x)) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:k]]


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean"])
def test_nearest_equal_plain_distances(monkeypatch, metric):
    monkeypatch.setattr(knn, "CHUNK", 7)
    ids = np.arange(len(X))
    got = knn.nearest_euclidean(ids, X, ids, X, 3, metric).sort_values(["i", "dist", "j"])
    assert list(got.itertuples(index=False, name=None)) == plain_edges(X, 3, metric)


def test_nearest_with_values_that_are_not_finite():
    x = np.array([[0.0], [1.0], [np.nan], [3.0], [np.inf], [1e200], [1.00001e200]])
    got = knn.nearest_euclidean(np.arange(7), x, np.arange(7), x, 1, "euclidean")
    assert dict(zip(got.i, got.j, strict=True)) == {0: 1, 1: 0, 3: 1}


def test_nearest_builds_no_column_of_all_differences(monkeypatch):
    monkeypatch.setattr(knn, "distances", lambda *a: pytest.fail("all differences"))
    x = RNG.standard_normal((50, 4))
    assert len(knn.nearest_euclidean(np.arange(50), x, np.arange(50), x, 3, "euclidean")) == 150


@pytest.mark.parametrize("grid", [False, True])
def test_rank_correlation_in_ranges(spark, monkeypatch, grid):
    if grid:
        monkeypatch.setattr(blocks.against_all, "__kwdefaults__", blocks.against_all.__kwdefaults__ | {"broadcast_bytes": 0, "block_rows": 30})
    monkeypatch.setattr(pairs, "RANGE_PAIRS", 100)
    monkeypatch.setattr(pairs, "pair_distances", lambda *a: pytest.fail("all pairs written out"))
    at = np.triu_indices(len(X), 1)
    a, b = (pd.Series(knn.distances(z, z, "euclidean")[at]).rank() for z in (X, Y))
    want = a.corr(b)
    assert pairs.rsa(table(spark, X, Y), "i", "z1", "z2", "spearman", "euclidean").first()[0] == pytest.approx(want, abs=1e-12)


def test_rank_correlation_without_spread(spark):
    assert pairs.rank_correlation(table(spark, X[:0], Y[:0]), "i", "z1", "z2", ("euclidean",) * 2).first()[0] is None
    assert pairs.rank_correlation(table(spark, np.ones((4, 2)), Y[:4]), "i", "z1", "z2", ("euclidean",) * 2).first()[0] is None


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_median_of_positive_distances(spark, monkeypatch, most):
    monkeypatch.setattr(pairs, "DRIVER_VALUES", most)
    monkeypatch.setattr(pairs, "pair_distances", lambda *a: pytest.fail("all pairs written out"))
    d = knn.distances(X, X, "euclidean")[np.triu_indices(len(X), 1)]
    assert pairs.median_distance(table(spark, X, Y), "i", "z1") == np.median(d[d > 0])
    assert pairs.median_distance(table(spark, np.ones((3, 2)), Y[:3]), "i", "z1") is None


def test_kernel_sums_hold_no_row_of_all(spark, monkeypatch):
    x, y = RNG.standard_normal((40, 3)), RNG.standard_normal((40, 3))
    widest, plain = [], knn.product_form
    monkeypatch.setattr(pairs, "CHUNK", 16)
    monkeypatch.setattr(pairs, "product_form", lambda a, b: widest.append(len(b)) or plain(a, b))
    held = {}
    monkeypatch.setattr(pairs, "against_all", lambda df, i, v, run, schema: held.setdefault("out", run(np.arange(40), [x, y], np.arange(40), [x, y])) is None or df)
    with pytest.raises(Exception):  # the sums were made above; the frame has no such columns
        pairs.kernel_sums(table(spark, x, y), "i", "z1", "z2", 0.5, 0.3).first()
    k, l = (np.exp(-g * knn.distances(z, z, "sqeuclidean")) for g, z in ((0.5, x), (0.3, y)))
    assert np.allclose(held["out"][["k", "l", "kl", "kk", "ll"]].to_numpy().T, [k.sum(1), l.sum(1), (k * l).sum(1), (k * k).sum(1), (l * l).sum(1)], atol=1e-9)
    assert max(widest) == 8


def test_kernels_of_rows_far_from_each_other_use_exact_distances(spark):
    x = np.array([[0.0, 0.0], [1e9, 0.0], [1e9, 1e-3]])
    got = pairs.kernel_sums(table(spark, x, x), "i", "z1", "z2", 1.0, 1.0).orderBy("i").toPandas()
    assert got.k.to_numpy() == pytest.approx([1, 1 + np.exp(-1e-6), 1 + np.exp(-1e-6)], abs=1e-12)


def test_anisotropy_needs_no_neighbours(spark, monkeypatch):
    monkeypatch.setattr(knn, "knn_edges", lambda *a: pytest.fail("neighbours"))
    x = RNG.standard_normal((30, 4))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert shape.anisotropy(table(spark, x, x), "z1") == pytest.approx((u @ u.T)[np.triu_indices(30, 1)].mean(), abs=1e-12)
