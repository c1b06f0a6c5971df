"""More queries of the catalogue: calibration, probes, shapes of arrays and the relational work between models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import images, knn, probes, relational, shape
from ..operators.quantiles import percentiles
from .catalogue import _emb, _rounded, _t, query

_W1 = "list_sum(list_transform(range(1, len(w)), lambda i: (w[i + 1] - w[i]) * abs(len(list_filter(a, lambda x: x <= w[i])) / len(a) - len(list_filter(b, lambda y: y <= w[i])) / len(b))))"


@query(
    "WITH g AS (SELECT l_orderkey, list(l_quantity) FILTER (l_returnflag = 'R') AS a, list(l_quantity) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1), "
    f"h AS (SELECT *, list_sort(list_concat(a, b)) AS w FROM g WHERE len(a) > 0 AND len(b) > 0) SELECT l_orderkey, round(coalesce({_W1}, 0), 6) AS distance FROM h"
)
def wasserstein_unequal(s, d):
    flag = F.col("l_returnflag") == "R"
    g = _t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(flag, F.col("l_quantity"))).alias("a"), F.collect_list(F.when(~flag, F.col("l_quantity"))).alias("b"))
    return _rounded(g.select("l_orderkey", arrays.wasserstein(F.col("a"), F.col("b")).alias("distance")).where("distance is not null"), "distance")


@query(
    "WITH m AS (SELECT o_orderpriority AS alias, o_orderstatus AS size, year(o_orderdate) AS modality, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2, 3) "
    "SELECT a.alias, a.size, a.modality AS modality_a, b.modality AS modality_b, round(a.score, 4) AS score_a, round(b.score, 4) AS score_b FROM m a JOIN m b ON a.alias = b.alias AND a.size = b.size AND a.modality < b.modality"
)
def crossmodal_pairs(s, d):
    m = _t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("alias"), F.col("o_orderstatus").alias("size"), F.year("o_orderdate").alias("modality")).agg(F.avg("o_totalprice").alias("score"))
    return _rounded(relational.cross_modal(m, ["alias", "size"], "modality", "score"), "score_a", "score_b", digits=4)


@query(
    "WITH m AS (SELECT o_custkey, avg(o_totalprice) AS x, avg(year(o_orderdate) * 1.0) AS y FROM orders GROUP BY 1), "
    "r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM m) "
    "SELECT count(*)::BIGINT AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r"
)
def score_correlation(s, d):
    o = _t(s, d, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    return _rounded(relational.score_correlation(o, "o_custkey", "o_totalprice", "y"), "pearson", "spearman")


_RULE = "(SELECT x FROM (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM (SELECT l_discount AS x FROM lineitem UNION ALL SELECT 0.095)) WHERE r = ceil(0.95 * n))"


@query(
    f"SELECT round({_RULE}, 6) AS tau, round(greatest(0, least(1, (0.095 - {_RULE}) / (1 - {_RULE}))), 6) AS calibrated_score, "
    "round((1 + count(*) FILTER (l_discount >= 0.095)) / (count(*) + 1), 6) AS p_value, round(avg(l_discount), 6) AS null_mean, round(stddev_pop(l_discount), 6) AS null_std FROM lineitem"
)
def calibration_rule(s, d):
    return _rounded(shape.calibration_rule(_t(s, d, "lineitem"), "l_discount", 0.095), "tau", "calibrated_score", "p_value", "null_mean", "null_std")


@query(
    "WITH q AS (SELECT quantile_cont(l_quantity, [0.01, 0.99]) AS a, quantile_cont(l_extendedprice, [0.01, 0.99]) AS b, quantile_cont(l_tax, [0.01, 0.99]) AS c FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, round(greatest(least(l_quantity, a[2]), a[1]), 4) AS l_quantity, round(greatest(least(l_extendedprice, b[2]), b[1]), 4) AS l_extendedprice, round(greatest(least(l_tax, c[2]), c[1]), 4) AS l_tax FROM lineitem, q"
)
def joint_clip(s, d):
    names = ["l_quantity", "l_extendedprice", "l_tax"]
    return _rounded(probes.joint_clip(_t(s, d, "lineitem").select("l_orderkey", "l_linenumber", *names), names), *names, digits=4)


_S = "sqrt(((va - vb) / 2) ** 2 + cab ** 2)"


@query(
    f"SELECT round((va + vb) / 2 + {_S}, 6) AS first, round((va + vb) / 2 - {_S}, 6) AS second FROM (SELECT var_samp(l_quantity / 10) AS va, var_samp(l_extendedprice / 10000) AS vb, covar_samp(l_quantity / 10, l_extendedprice / 10000) AS cab FROM lineitem)"
)
def pca_variances(s, d):
    """The variances along the two principal axes, from the projected rows."""
    p = probes.project(_t(s, d, "lineitem").select(F.array(F.col("l_quantity") / 10, F.col("l_extendedprice") / 10000).alias("v")), "v", 2)
    return _rounded(p.agg(F.var_samp(F.col("projected")[0]).alias("first"), F.var_samp(F.col("projected")[1]).alias("second")), "first", "second")


@query()
def pca_padded(s, d):
    """Projections to 50 axes, filled up to 64."""
    return probes.project(_emb(s, d), "embedding", 50, width=64).select("row_id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


def _weights(y: str) -> str:
    return f"(v2 * p{y} - cab * q{y}) AS a{y}, (v1 * q{y} - cab * p{y}) AS b{y}"


_COSINE = " UNION ALL ".join(
    f"SELECT '{a}' AS value_a, '{b}' AS value_b, round((a{i} * a{j} + b{i} * b{j}) / (sqrt(a{i} ** 2 + b{i} ** 2) * sqrt(a{j} ** 2 + b{j} ** 2)), 5) AS cosine FROM w"
    for i, a in enumerate(("l_extendedprice", "l_discount", "l_linenumber")) for j, b in enumerate(("l_extendedprice", "l_discount", "l_linenumber"))
)
_COVARIANCES = ", ".join(f"covar_pop(l_quantity / 10, {y}) AS p{i}, covar_pop(l_tax * 100, {y}) AS q{i}" for i, y in enumerate(("l_extendedprice", "l_discount", "l_linenumber")))


@query(
    f"WITH m AS (SELECT var_pop(l_quantity / 10) AS v1, var_pop(l_tax * 100) AS v2, covar_pop(l_quantity / 10, l_tax * 100) AS cab, {_COVARIANCES} FROM lineitem), w AS (SELECT {', '.join(_weights(str(i)) for i in range(3))} FROM m) {_COSINE}"
)
def probe_cosine(s, d):
    rows = _t(s, d, "lineitem").withColumn("v", F.array(F.col("l_quantity") / 10, F.col("l_tax") * 100))
    return _rounded(probes.probe_weight_cosines(rows, "v", ["l_extendedprice", "l_discount", "l_linenumber"]), "cosine", digits=5)


_FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS model_a, '{b}' AS model_b, round(1 - corr({a}, {b}) ** 2, 6) AS disparity FROM lineitem" for i, a in enumerate(_FOUR) for b in _FOUR[i + 1 :]))
def disparity_pairs(s, d):
    return _rounded(probes.disparities(_t(s, d, "lineitem"), _FOUR), "disparity")


@query()
def physics_summary(s, d):
    """Grand mean and standard error of the linear probes of two properties."""
    return probes.probe_summary(probes.run_physics(_emb(s, d), "row_id", "z1", ["y", "label"]))


@query()
def linear_probe_pca(s, d):
    r = probes.linear_probe(_emb(s, d), "row_id", "z1", "y", 5, pca_components=8)
    return s.createDataFrame([(round(r["mean"], 6), round(r["std"], 6))], "mean double, std double")


@query(
    "SELECT vec_id, round(list_aggregate(embedding::DOUBLE[], 'quantile_cont', 0.05), 6) AS low, round(list_aggregate(embedding::DOUBLE[], 'quantile_cont', 0.99), 6) AS high FROM embeddings "
    "WHERE list_aggregate(embedding::DOUBLE[], 'quantile_cont', 0.05) <> list_aggregate(embedding::DOUBLE[], 'quantile_cont', 0.99)"
)
def dynamic_range(s, d):
    e = _t(s, d, "embeddings").where(arrays.has_range(F.col("embedding")))
    return _rounded(e.select("vec_id", arrays.percentile(F.col("embedding"), 0.05).alias("low"), arrays.percentile(F.col("embedding"), 0.99).alias("high")), "low", "high")


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS g, round(embedding[2]::DOUBLE, 6) AS r, round(embedding[4]::DOUBLE, 6) AS z FROM embeddings")
def band_pick(s, d):
    e = _t(s, d, "embeddings").select("vec_id", arrays.pick(arrays.doubles(F.col("embedding")), [0, 1, 3]).alias("b"))
    return _rounded(e.select("vec_id", *[F.col("b")[i].alias(n) for i, n in enumerate("grz")]), "g", "r", "z")


@query(
    "SELECT vec_id, round(list_avg(list_transform(range(0, 8), lambda t: embedding[1 + 8 * t]::DOUBLE)), 6) AS mean_first, round(embedding[8]::DOUBLE, 6) AS first_last, round(embedding[57]::DOUBLE, 6) AS last_first FROM embeddings"
)
def pooling(s, d):
    """Eight tokens of eight numbers each: components of the mean, the first and the last token."""
    tokens = arrays.windows(arrays.doubles(F.col("embedding")), 8, 8)
    e = _t(s, d, "embeddings").select("vec_id", tokens.alias("t")).select("vec_id", *[arrays.pool(F.col("t"), how).alias(how) for how in ("mean", "first", "last")])
    return _rounded(e.select("vec_id", F.col("mean")[0].alias("mean_first"), F.col("first")[7].alias("first_last"), F.col("last")[0].alias("last_first")), "mean_first", "first_last", "last_first")


@query("SELECT label, (p - 1)::INTEGER AS pos, round(avg(embedding[p]::DOUBLE), 5) + 0.0 AS mean FROM embeddings, range(1, 65) t(p) GROUP BY 1, 2")
def mean_vectors(s, d):
    return _rounded(relational.mean_matrix(_t(s, d, "embeddings").withColumn("embedding", arrays.doubles(F.col("embedding"))), ["label"], "embedding"), "mean", digits=5)


@query("SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(value)::BIGINT AS n FROM events GROUP BY 1")
def value_summary(s, d):
    return _rounded(relational.summary(_t(s, d, "events"), ["event_type"], "value"), "mean")


@query("SELECT c_custkey, count(*)::BIGINT AS n_blocks FROM (SELECT DISTINCT c_custkey FROM customer) JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def block_counts(s, d):
    return relational.with_counts(_t(s, d, "customer"), _t(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("SELECT r_name, r_regionkey FROM region WHERE r_name IN ('EUROPE', 'ASIA', 'AFRICA')")
def reordered_rows(s, d):
    return relational.in_order(_t(s, d, "region").select("r_name", "r_regionkey"), "r_name", ["EUROPE", "ASIA", "AFRICA"])


@query(
    "WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS k FROM supplier) SELECT a.s_suppkey AS one, b.s_suppkey AS two FROM a JOIN b USING (k)"
)
def truncated_pair(s, d):
    a = _t(s, d, "supplier").select("s_suppkey")
    b = _t(s, d, "supplier").select("s_suppkey", F.struct("s_acctbal", "s_suppkey").alias("o"))
    return relational.truncated_pair(a, b, "s_suppkey", "o").select(F.col("a.s_suppkey").alias("one"), F.col("b.s_suppkey").alias("two"))


@query("SELECT event_id, event_type, round(value, 4) AS value FROM events")
def json_fields(s, d):
    """Fields written as JSON and read back by their paths."""
    j = _t(s, d, "events").select("event_id", F.to_json(F.struct("event_type", F.struct("value").alias("inner"))).alias("j"))
    return _rounded(j.select("event_id", F.get_json_object("j", "$.event_type").alias("event_type"), F.from_json("j", "inner struct<value: double>")["inner"]["value"].alias("value")), "value", digits=4)


@query()
def knn_approximate(s, d):
    return _rounded(knn.knn_edges_approximate(_emb(s, d), "row_id", "embedding", 10), "dist")


@query()
def fitted_images(s, d):
    """Vectors as 8 x 8 images, cropped to what stands out at their centre and resized to 16 x 16."""
    image = arrays.windows(arrays.doubles(F.col("embedding")), 8, 8)
    return images.fit_images(_t(s, d, "embeddings").select("vec_id", image.alias("image")), "vec_id", "image", size=16).select("vec_id", "blob_size", F.size("fitted").alias("height"), F.size(F.col("fitted")[0]).alias("width"))


@query(
    "WITH e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS u FROM embeddings), "
    "x AS (SELECT i, unnest(v) AS x, generate_subscripts(v, 1) AS c FROM e), s AS (SELECT p.c = q.c AS own, covar_samp(p.x, q.x) AS v FROM x p JOIN x q USING (i) GROUP BY p.c, q.c), "
    "g AS (SELECT p.i, list_distance(p.v, q.v) AS d, row_number() OVER (PARTITION BY p.i ORDER BY list_distance(p.v, q.v)) AS r FROM e p JOIN e q ON p.i <> q.i) "
    "SELECT 'mean_l2_norm' AS statistic, round(avg(sqrt(list_sum(list_transform(v, lambda x: x * x)))), 6) AS value FROM e UNION ALL "
    "SELECT 'anisotropy', round(avg(list_dot_product(p.u, q.u)), 6) FROM e p JOIN e q ON p.i < q.i UNION ALL "
    "SELECT 'participation_ratio', round(sum(v) FILTER (own) ** 2 / sum(v * v), 6) FROM s UNION ALL SELECT 'knn_dist_p50', round(quantile_disc(d, 0.5), 6) FROM g WHERE r = 10"
)
def shape_moments(s, d):
    """The shape statistics that need no spectrum: the ratio of squared trace to squared norm is the participation ratio."""
    found = shape.shape_statistics(_emb(s, d), "row_id", "embedding")
    return _rounded(found.where(F.col("statistic").isin("mean_l2_norm", "anisotropy", "participation_ratio", "knn_dist_p50")), "value")


@query(
    "SELECT l_linestatus, l_returnflag, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.999), 4) AS p999 FROM lineitem GROUP BY 1, 2"
)
def percentiles_by_keys(s, d):
    found = percentiles(_t(s, d, "lineitem"), "l_extendedprice", [0.5, 0.999], ("l_linestatus", "l_returnflag"))
    return _rounded(s.createDataFrame([(*k, *q) for k, q in found.items()], "l_linestatus string, l_returnflag string, median double, p999 double"), "median", "p999", digits=4)
