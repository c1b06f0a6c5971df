"""Properties of the metrics on seeded matrices, and direct numpy forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embralign.functions import arrays
from embralign.operators import images, knn, metrics, moments as moments_module, pairs, probes, relational, shape
from embralign.sources import embeddings
from embralign.operators.moments import paired_moments

RNG = np.random.default_rng(42)
A = RNG.standard_normal((60, 6))
B = A @ RNG.standard_normal((6, 6)) + 0.1 * RNG.standard_normal((60, 6))
Q = np.linalg.qr(RNG.standard_normal((6, 6)))[0]


def table(spark, a, b):
    return spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "row_id long, z1 array<double>, z2 array<double>")


def moments(spark, a, b):
    return paired_moments(table(spark, a, b))


def test_identity_and_invariance(spark):
    same, turned = moments(spark, A, A), moments(spark, A + 1000, 3 * A @ Q)
    for f in (metrics.cka, metrics.svcca, metrics.pwcca):
        assert f(same) == pytest.approx(1, abs=1e-5)
    assert metrics.cka(turned) == pytest.approx(1, abs=1e-9)
    assert metrics.procrustes(turned) == pytest.approx(0, abs=1e-6)
    for f in (metrics.procrustes, metrics.frechet, metrics.eigenspectrum, metrics.riemannian, metrics.kl_divergence, metrics.js_divergence, metrics.mmd_linear, metrics.mmd_polynomial):
        assert f(same) == pytest.approx(0, abs=1e-5)


def test_against_numpy(spark):
    m = moments(spark, A, B)
    a, b = A - A.mean(0), B - B.mean(0)
    k, l = a @ a.T, b @ b.T
    assert metrics.cka(m) == pytest.approx((k * l).sum() / np.sqrt((k * k).sum() * (l * l).sum()))
    w = np.linalg.solve(a.T @ a + np.eye(6), a.T @ b)
    assert metrics.linear_r2(m) == pytest.approx((1 - ((b - a @ w) ** 2).sum(0) / (b**2).sum(0)).mean())
    assert metrics.tucker(m) == pytest.approx((np.abs((A * B).sum(0)) / np.sqrt((A**2).sum(0) * (B**2).sum(0))).mean())


def test_same_for_any_partitioning(spark):
    df = table(spark, A, B)
    values = {round(metrics.cka(paired_moments(df.repartition(n))), 10) for n in (1, 3, 16)}
    assert len(values) == 1
    edges = [knn.knn_edges(df.repartition(n), "row_id", "z1", 5).orderBy("i", "rank").select("i", "j").collect() for n in (1, 7)]
    assert edges[0] == edges[1]


def test_edges_by_grid_and_by_expressions(spark):
    df = table(spark, A, B)
    one = {(r.i, r.j) for r in knn.knn_edges(df, "row_id", "z1", 4).collect()}
    assert one == {(r.i, r.j) for r in knn.knn_edges(df, "row_id", "z1", 4, broadcast_bytes=0, block_rows=16).collect()}
    assert one == {(r.i, r.j) for r in knn.knn_edges_sql(df, "row_id", "z1", 4).collect()}


def test_rsa_and_errors(spark):
    df = table(spark, A, A)
    assert pairs.rsa(df, "row_id", "z1", "z2").first().correlation == pytest.approx(1)
    with pytest.raises(ValueError):
        pairs.rsa(df, "row_id", "z1", "z2", "kendall")
    with pytest.raises(ValueError):
        metrics.compare(df, "row_id", "z1", "z2", ["nonsense"])
    with pytest.raises(ValueError):
        metrics.riemannian(moments(spark, A, B), "euclid")


def test_compare_reports_failures(spark):
    got = {r.metric: r for r in metrics.compare(table(spark, A, B[:, :3]), "row_id", "z1", "z2", ["cka", "procrustes", "mknn"], mknn__k=3).collect()}
    assert got["procrustes"].value is None and "dimensions" in got["procrustes"].error
    assert got["cka"].value is not None and got["mknn"].error is None
    assert len(metrics.list_metrics()) == 17


def test_linear_probe_against_numpy(spark):
    y = A @ RNG.standard_normal(6)
    df = spark.createDataFrame([(i, x.tolist(), float(v)) for i, (x, v) in enumerate(zip(A, y, strict=True))], "row_id long, z array<double>, y double")
    got = probes.linear_probe(df, "row_id", "z", "y", 5)
    lo, hi = np.quantile(y, [0.01, 0.99])
    keep = (y >= lo) & (y <= hi)
    u, v = (A / np.linalg.norm(A, axis=1, keepdims=True))[keep], y[keep]
    scores = []
    for test in np.array_split(np.arange(len(v)), 5):
        train = np.setdiff1d(np.arange(len(v)), test)
        x = np.c_[u, np.ones(len(u))]
        w = np.linalg.lstsq(x[train], v[train], rcond=None)[0]
        scores.append(1 - ((v[test] - x[test] @ w) ** 2).sum() / ((v[test] - v[test].mean()) ** 2).sum())
    assert got["mean"] == pytest.approx(np.mean(scores), abs=1e-8)


def test_truncation_is_a_clip(spark):
    df = table(spark, A, B)
    got = knn.truncate_outliers(df, "z1", 90).select(F.array_max(F.transform("z1", F.abs)).alias("m")).agg(F.max("m")).first()[0]
    assert got == pytest.approx(np.percentile(np.abs(A), 90))


def test_tiled_moments(spark, monkeypatch):
    whole = moments(spark, A, B)
    monkeypatch.setattr(moments_module, "TILE", 7)
    tiled = paired_moments(table(spark, A, B).repartition(5))
    assert metrics.cka(tiled) == pytest.approx(metrics.cka(whole), abs=1e-12) and tiled.n == 60
    keyed = moments_module.moments_by_key(table(spark, A, B).withColumn("k", F.when(F.col("row_id") % 3 > 0, F.col("row_id") % 3)), "z1", "z2", "k")
    assert {k: m.n for k, m in keyed.items()} == {None: 20, "1": 20, "2": 20}


def test_projections(spark):
    df = table(spark, A, B)
    got = np.array([r.projected for r in probes.project(df, "z1", 3, width=5).orderBy("row_id").collect()])
    u, s, _ = np.linalg.svd(A - A.mean(0), full_matrices=False)
    assert np.abs(got[:, :3]) == pytest.approx(np.abs(u[:, :3] * s[:3])) and not got[:, 3:].any()
    y = A @ RNG.standard_normal(6)
    rows = spark.createDataFrame([(i, x.tolist(), float(v)) for i, (x, v) in enumerate(zip(A, y, strict=True))], "row_id long, z array<double>, y double")
    z = A / np.linalg.norm(A, axis=1, keepdims=True)
    lo, hi = np.quantile(y, [0.01, 0.99])
    z, v = z[(y >= lo) & (y <= hi)], y[(y >= lo) & (y <= hi)]
    scores = []
    for test in np.array_split(np.arange(len(v)), 4):
        train = np.setdiff1d(np.arange(len(v)), test)
        axes = np.linalg.svd(z[train] - z[train].mean(0), full_matrices=False)[2][:2].T
        x = np.c_[(z - z[train].mean(0)) @ axes, np.ones(len(z))]
        w = np.linalg.lstsq(x[train], v[train], rcond=None)[0]
        scores.append(1 - ((v[test] - x[test] @ w) ** 2).sum() / ((v[test] - v[test].mean()) ** 2).sum())
    assert probes.linear_probe(rows, "row_id", "z", "y", 4, pca_components=2)["folds"] == pytest.approx(scores)


def test_calibration(spark):
    df = table(spark, A, B)
    cka = lambda a, b: float((((a - a.mean(0)).T @ (b - b.mean(0))) ** 2).sum())
    got = shape.calibrate(df, "row_id", "z1", "z2", cka, permutations=60, seed=3)
    a, b = A.astype(np.float32), B.astype(np.float32)
    nulls = np.array([cka(a, b[np.random.default_rng([3, p]).permutation(60)]) for p in range(60)])
    every = np.sort(np.append(nulls, cka(a, b)))
    assert got["threshold"] == pytest.approx(every[int(np.ceil(0.95 * 61)) - 1]) and got["p_value"] == pytest.approx((1 + (nulls >= cka(a, b)).sum()) / 61)
    assert shape.cell_seed(7, 2, 3) == 20_010
    rule = shape.calibration_rule(spark.createDataFrame([(float(x),) for x in nulls], "x double"), "x", cka(a, b), most=1e9).first()
    assert rule.tau == pytest.approx(got["threshold"]) and rule.p_value == pytest.approx(got["p_value"])


def test_arrays(spark):
    row = spark.createDataFrame([([1.0, 5.0, float("nan")], [2.0, 2.0, 9.0, None], [[1.0, 2.0], [3.0, 6.0]], [4.0] * 3)], "a array<double>, b array<double>, t array<array<double>>, flat array<double>")
    got = row.select(
        arrays.wasserstein(F.col("a"), F.col("b")).alias("w"), arrays.wasserstein(F.col("a"), F.array().cast("array<double>")).alias("none"), arrays.percentile(F.col("b"), 0.25).alias("p"),
        arrays.has_range(F.col("flat")).alias("r"), arrays.pick(F.col("b"), [2, 0, 0]).alias("k"), arrays.pool(F.col("t")).alias("m"), arrays.windows(F.col("flat"), 2, 1).alias("s"), arrays.windows(F.col("flat"), 4, 1).alias("s4"),
    ).first()
    assert got.w == pytest.approx(1 * 0.5 + 3 * (2 / 3 - 0.5) + 4 * (1 - 2 / 3)) and got.none is None and got.p == 2 and not got.r
    assert (got.k, got.m, got.s, got.s4) == ([9, 2, 2], [2, 4], [[4, 4], [4, 4]], [])


def test_tables_of_embeddings(spark, tmp_path):
    path = str(tmp_path / "e")
    rows = [(i, x.tolist(), y.tolist(), x.tolist()) for i, (x, y) in enumerate(zip(A, B, strict=True))]
    spark.createDataFrame(rows, "id long, vit_base_hsc array<double>, vit_base_jwst array<double>, vit_lm_head array<double>").write.parquet(path)
    assert embeddings.parse_column("a_b_base_hsc") == ("a_b", "base", "hsc")
    assert embeddings.blocks(spark, path) == ([("vit_base_hsc", 6), ("vit_base_jwst", 6)], 60)
    got = {r.metric: r.value for r in embeddings.compare_from_parquet(spark, path, "id", ["cka", "linear_r2"], "base").collect()}
    assert got["cka"] == pytest.approx(metrics.cka(moments(spark, A, B)))
    assert embeddings.load_single(spark, path, "id", "base", "jwst").count() == 60
    with pytest.raises(ValueError):
        embeddings.load_pair(spark, path, "id", "lm")
    for bad in ([(1, [1.0], [1.0])], [(1, [1.0], [1.0]), (2, [float("nan")], [1.0])], [(1, [1.0], [1.0]), (2, [1.0, 2.0], [1.0])], [(1, [1.0], [1.0]), (2, None, [1.0])]):
        with pytest.raises(ValueError):
            embeddings.validate_inputs(spark.createDataFrame(bad, "i long, z1 array<double>, z2 array<double>"), "z1", "z2")
    embeddings.append_text(spark.createDataFrame([("a",), ("b",)], "line string"), str(tmp_path / "t"))
    embeddings.append_text(spark.createDataFrame([("c",)], "line string"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 3
    embeddings.write_csv_union([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")], str(tmp_path / "c"))
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "c")).columns) == ["a", "b"]


def test_samples_and_pairs(spark):
    df = table(spark, A, B).select((F.col("row_id") * 2).alias("row_id"))
    some = sorted(r.row_id for r in relational.subsample(df, "row_id", 7, 5).collect())
    assert some == (2 * np.sort(np.random.default_rng(5).choice(60, 7, replace=False))).tolist()
    old = sorted(r.row_id for r in relational.subsample(df, "row_id", 7, 42, legacy=True).collect())
    assert old == sorted((2 * np.random.RandomState(42).choice(60, 7, replace=False)).tolist()) and relational.subsample(df, "row_id", 99, 1).count() == 60
    pairs_of = relational.random_pairs(df, "row_id", 1, 50).collect()
    assert 40 < len(pairs_of) <= 50 and all(r.i != r.j and r.i % 2 == 0 for r in pairs_of)
    with pytest.raises(ValueError):
        relational.truncated_pair(df, df.where("row_id < 60"), "row_id", "row_id")


def test_approximate_neighbours(spark):
    rng = np.random.default_rng(8)
    m = np.vstack([rng.standard_normal((600, 16)), rng.standard_normal(16) + 0.2 * rng.standard_normal((600, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "row_id long, z array<double>")
    exact = {(r.i, r.j) for r in knn.knn_edges(df, "row_id", "z", 5).collect()}
    near = {(r.i, r.j) for r in knn.knn_edges_approximate(df, "row_id", "z", 5, block=100).collect()}
    assert len(near) == len(exact) and len(near & exact) >= 0.9 * len(exact)
    assert {(r.i, r.j) for r in knn.knn_edges_approximate(df, "row_id", "z", 5, lists=9, probes=9, stored=1).collect()} == exact
    assert knn.knn_edges_approximate(df.limit(0), "row_id", "z").count() == 0


def test_images(spark):
    y, x = np.mgrid[:120, :120]
    disk = (((y - 60) ** 2 + (x - 60) ** 2) < 20**2) * 1.0
    other = (((y - 10) ** 2 + (x - 110) ** 2) < 8**2) * 1.0
    assert images.otsu(np.r_[np.zeros(50), np.ones(30)]) < 0.5
    assert images.centre_blob(disk + other > 0) == (int(disk.sum()), (41, 79, 41, 79)) and images.centre_blob(other > 0) == (0, None)
    flat = np.full((30, 30), 2.0)
    assert images.blur(flat) == pytest.approx(flat)
    square = np.arange(12.0).reshape(3, 4)
    twice = images.resized(square, 2)
    assert twice.shape == (6, 8) and twice[0, 0] == 0 and twice[-1, -1] == 11 and twice[0] == pytest.approx(np.linspace(0, 3, 8))
    rows = [(1, (disk + other).tolist()), (2, None), (3, [])]
    got = {r.i: r for r in images.fit_images(spark.createDataFrame(rows, "i int, image array<array<double>>"), "i", "image").collect()}
    out = np.array(got[1].fitted)
    assert out.shape == (96, 96) and got[1].blob_size > 500 and 0.3 < out.mean() < 0.8 and out[48, 48] == 1 and out[0, 0] == 0
    assert got[2].fitted is None and got[3].blob_size is None
    assert images.fitted(disk, extent=(40, 79, 40, 79))[1].shape == (96, 96)
