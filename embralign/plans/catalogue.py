"""The engine's queries over the driver tables, and the equal DuckDB SQL. Floats are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import knn, metrics, pairs, probes, relational, shape
from ..operators.moments import paired_moments
from ..operators.quantiles import percentiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _emb(s, d, a: int = 32, b: int = 32) -> DataFrame:
    e = _t(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.slice("embedding", 1, a).alias("z1"), F.slice("embedding", 65 - b, b).alias("z2"), "embedding", F.element_at("embedding", 64).cast("double").alias("y"), F.element_at("embedding", 63).cast("double").alias("y2"), "label")


def _mixed(s, d) -> DataFrame:
    """Two correlated features a side, from lineitem."""
    q, e, t, x = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount"))
    return _t(s, d, "lineitem").select(F.array(q / 10, e / 10000).alias("z1"), F.array(q / 10 + 20 * x, e / 10000 - 30 * t).alias("z2"))


def _value(s: SparkSession, name: str, value: float) -> DataFrame:
    return s.createDataFrame([(round(float(value), 6) + 0.0,)], f"{name} double")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), digits) + F.lit(0.0))
    return df


E_SQL = "e AS (SELECT vec_id AS i, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b, embedding[64]::DOUBLE AS y, embedding[63]::DOUBLE AS y2, embedding::DOUBLE[] AS v, label FROM embeddings)"


def _edges_sql(name: str, vector: str, k: int = 10, dist: str | None = None) -> str:
    dist = dist or f"1 - list_cosine_similarity(p.{vector}, q.{vector})"
    return f"{name} AS (SELECT * FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM (SELECT p.i, q.i AS j, {dist} AS d FROM e p, e q WHERE p.i <> q.i)) WHERE r <= {k})"


# ---- neighbour metrics


def _two_graphs(s, d, k: int = 10):
    e = _emb(s, d)
    return knn.knn_edges(e, "row_id", "z1", k), knn.knn_edges(e, "row_id", "z2", k)


@query(f"WITH {E_SQL}, {_edges_sql('g', 'a')}, {_edges_sql('h', 'b')} SELECT round(count(*) / ((SELECT count(*) FROM e) * 10.0), 6) AS mknn FROM g JOIN h USING (i, j)")
def mknn(s, d):
    return _rounded(knn.mknn_from_edges(*_two_graphs(s, d), 10), "mknn")


@query(f"WITH {E_SQL}, {_edges_sql('g', 'a')}, {_edges_sql('h', 'b')}, c AS (SELECT i, count(h.j) AS n FROM g LEFT JOIN h USING (i, j) GROUP BY i) SELECT round(avg(n / (20.0 - n)), 6) AS jaccard FROM c")
def jaccard(s, d):
    return _rounded(knn.jaccard_from_edges(*_two_graphs(s, d), 10), "jaccard")


@query(f"WITH {E_SQL}, {_edges_sql('g', 'a')} SELECT i, j, r::INTEGER AS rank, round(d, 6) AS dist FROM g")
def knn_edges(s, d):
    return _rounded(knn.knn_edges(_emb(s, d), "row_id", "z1", 10), "dist")


@query(f"WITH {E_SQL}, {_edges_sql('g', 'a', 10, 'list_distance(p.a, q.a)')} SELECT i, j, r::INTEGER AS rank, round(d, 6) AS dist FROM g")
def knn_euclid(s, d):
    return _rounded(knn.knn_edges(_emb(s, d), "row_id", "z1", 10, "euclidean"), "dist")


@query(f"WITH {E_SQL}, {_edges_sql('g', 'a', 20)}, {_edges_sql('h', 'b', 20)}, ks AS (SELECT unnest([5, 10, 20]) AS k) SELECT k::INTEGER AS k, round(count(*) / ((SELECT count(*) FROM e) * k::DOUBLE), 6) AS mknn FROM g JOIN h USING (i, j), ks WHERE g.r <= k AND h.r <= k GROUP BY k")
def knn_multi_k(s, d):
    """One build at the largest k, smaller ones by rank."""
    a, b = _two_graphs(s, d, 20)
    both = a.select("i", "j", F.col("rank").alias("ra")).join(b.select("i", "j", F.col("rank").alias("rb")), ["i", "j"])
    n = a.select("i").distinct().count()
    ks = F.explode(F.array(*map(F.lit, (5, 10, 20)))).alias("k")
    return _rounded(both.select("ra", "rb", ks).where("ra <= k and rb <= k").groupBy("k").agg((F.count("*") / (n * F.col("k"))).alias("mknn")), "mknn")


def _clip_sql(v: str) -> str:
    return f"[greatest(-t.{v}q, least(t.{v}q, x)) FOR x IN {v}]"


@query(
    "WITH e0 AS (SELECT vec_id AS i, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings), t AS (SELECT (SELECT quantile_cont(abs(x), 0.95) FROM (SELECT unnest(a) AS x FROM e0)) AS aq, (SELECT quantile_cont(abs(x), 0.95) FROM (SELECT unnest(b) AS x FROM e0)) AS bq), "
    f"e AS (SELECT i, {_clip_sql('a')} AS a, {_clip_sql('b')} AS b FROM e0, t), {_edges_sql('g', 'a')}, {_edges_sql('h', 'b')} SELECT round(count(*) / ((SELECT count(*) FROM e) * 10.0), 6) AS mknn FROM g JOIN h USING (i, j)"
)
def mknn_truncated(s, d):
    e = _emb(s, d).select("row_id", "z1", "z2")
    e = knn.truncate_outliers(knn.truncate_outliers(e, "z1", 95), "z2", 95)
    return _rounded(knn.mknn_from_edges(knn.knn_edges(e, "row_id", "z1"), knn.knn_edges(e, "row_id", "z2"), 10), "mknn")


@query(f"WITH {E_SQL}, {_edges_sql('g', 'v')}, l AS (SELECT g.i, stddev_pop(q.y) AS sd FROM g JOIN e q ON q.i = g.j GROUP BY g.i) SELECT round(avg(sd) / (SELECT stddev_pop(y) FROM e), 6) AS consistency FROM l")
def neighbor_consistency(s, d):
    e = _emb(s, d)
    return _rounded(knn.property_consistency(knn.knn_edges(e, "row_id", "embedding"), e, "row_id", "y"), "consistency")


@query(f"WITH {E_SQL}, {_edges_sql('g', 'v')}, {_edges_sql('h', 'v', 10, 'abs(p.y - q.y)')} SELECT round(count(*) / ((SELECT count(*) FROM e) * 10.0), 6) AS overlap FROM g JOIN h USING (i, j)")
def neighbor_set_overlap(s, d):
    return _rounded(probes.neighbour_set_overlap(_emb(s, d), "row_id", "embedding", ["y"]), "overlap")


@query(
    f"WITH {E_SQL}, m AS (SELECT stddev_pop(y) AS s1, stddev_pop(y2) AS s2 FROM e), {_edges_sql('g', 'v')}, {_edges_sql('h', 'v', 10, 'sqrt(((p.y - q.y) / (SELECT s1 FROM m)) ** 2 + ((p.y2 - q.y2) / (SELECT s2 FROM m)) ** 2)')} "
    "SELECT round(count(*) / ((SELECT count(*) FROM e) * 10.0), 6) AS overlap FROM g JOIN h USING (i, j)"
)
def joint_overlap(s, d):
    return _rounded(probes.neighbour_set_overlap(_emb(s, d), "row_id", "embedding", ["y", "y2"], scale=True), "overlap")


@query(
    f"WITH {E_SQL}, {_edges_sql('g', 'a')}, {_edges_sql('h', 'b')}, u AS (SELECT i, y, row_number() OVER (PARTITION BY g.i ORDER BY q.y) AS r FROM g JOIN (SELECT i AS j, y FROM e) q USING (j)), "
    "w AS (SELECT i, y, row_number() OVER (PARTITION BY h.i ORDER BY q.y) AS r FROM h JOIN (SELECT i AS j, y FROM e) q USING (j)) SELECT i, round(avg(abs(u.y - w.y)), 6) AS distance FROM u JOIN w USING (i, r) GROUP BY i"
)
def wasserstein_neighbors(s, d):
    return _rounded(knn.neighbour_wasserstein(*_two_graphs(s, d), _emb(s, d), "row_id", "y"), "distance")


@query(
    f"WITH {E_SQL}, {_edges_sql('g', 'v')}, q AS (SELECT quantile_cont(y, {[k / 20 for k in range(1, 20)]}) AS q FROM e), b AS (SELECT i, len(list_filter(q, lambda x: x <= y)) AS bin FROM e, q) "
    "SELECT g.i, round(avg(CASE WHEN m.bin = o.bin THEN 1.0 ELSE 0.0 END), 6) AS purity FROM g JOIN b m ON m.i = g.i JOIN b o ON o.i = g.j GROUP BY g.i"
)
def knn_purity(s, d):
    e = _emb(s, d)
    return _rounded(knn.knn_purity(knn.knn_edges(e, "row_id", "embedding"), e, "row_id", "y"), "purity")


@query(f"WITH {E_SQL}, {_edges_sql('g', 'v', 2, 'list_distance(p.v, q.v)')}, r AS (SELECT i, max(d) FILTER (r = 1) AS r1, max(d) FILTER (r = 2) AS r2 FROM g GROUP BY i) SELECT i, CASE WHEN r1 > 0 AND r2 / r1 > 1 THEN round(ln(2.0) / ln(r2 / r1), 4) END AS dimension FROM r")
def twonn_local(s, d):
    return _rounded(knn.two_nn_local(knn.knn_edges(_emb(s, d), "row_id", "embedding", 2, "euclidean")), "dimension", digits=4)


@query(f"WITH {E_SQL}, {_edges_sql('g', 'v', 2, 'list_distance(p.v, q.v)')}, r AS (SELECT i, max(d) FILTER (r = 1) AS r1, max(d) FILTER (r = 2) AS r2 FROM g GROUP BY i) SELECT round(count(*) / sum(ln(r2 / r1)), 6) AS dimension FROM r WHERE r1 > 1e-12 AND r2 > r1")
def twonn_global(s, d):
    return _rounded(knn.two_nn_global(knn.knn_edges(_emb(s, d), "row_id", "embedding", 2, "euclidean")), "dimension")


_MODELS = ", ".join(f"('m{k}', {16 * k + 1}, {16 * k + 16})" for k in range(4))


@query(
    f"WITH m(name, lo, hi) AS (VALUES {_MODELS}), e AS (SELECT name, vec_id AS i, embedding[lo:hi]::DOUBLE[] AS v FROM embeddings, m), g AS (SELECT * FROM (SELECT p.name, p.i, q.i AS j, row_number() OVER (PARTITION BY p.name, p.i ORDER BY 1 - list_cosine_similarity(p.v, q.v), q.i) AS r FROM e p JOIN e q ON p.name = q.name AND p.i <> q.i) WHERE r <= 20), "
    "ks AS (SELECT unnest([5, 10, 20]) AS k) SELECT k::INTEGER AS k, a.name AS model_i, b.name AS model_j, round(count(*) / ((SELECT count(*) FROM embeddings) * k::DOUBLE), 6) AS mknn FROM g a JOIN g b ON a.i = b.i AND a.j = b.j AND a.name <> b.name, ks WHERE a.r <= k AND b.r <= k GROUP BY k, a.name, b.name"
)
def pair_matrix(s, d):
    """Overlap of every two models' graphs at three k, both orders."""
    e = _t(s, d, "embeddings")
    edges = None
    for k in range(4):
        one = knn.knn_edges(e.select("vec_id", F.slice("embedding", 16 * k + 1, 16).alias("v")), "vec_id", "v", 20).withColumn("model", F.lit(f"m{k}"))
        edges = one if edges is None else edges.unionByName(one)
    a = edges.select("i", "j", F.col("rank").alias("ra"), F.col("model").alias("model_i"))
    b = edges.select("i", "j", F.col("rank").alias("rb"), F.col("model").alias("model_j"))
    ks = F.explode(F.array(*map(F.lit, (5, 10, 20)))).alias("k")
    both = a.join(b, ["i", "j"]).where("model_i <> model_j").select("*", ks).where("ra <= k and rb <= k")
    return _rounded(both.groupBy("k", "model_i", "model_j").agg((F.count("*") / (e.count() * F.col("k"))).alias("mknn")), "mknn")


# ---- moments


@query(
    f"WITH {E_SQL}, x AS (SELECT i, unnest(a) AS x, generate_subscripts(a, 1) AS c FROM e), y AS (SELECT i, unnest(b) AS y, generate_subscripts(b, 1) AS c FROM e), xx AS (SELECT p.c, q.c AS c2, covar_pop(p.x, q.x) AS v FROM x p JOIN x q USING (i) GROUP BY 1, 2), yy AS (SELECT p.c, q.c AS c2, covar_pop(p.y, q.y) AS v FROM y p JOIN y q USING (i) GROUP BY 1, 2), "
    "xy AS (SELECT p.c, q.c AS c2, covar_pop(p.x, q.y) AS v FROM x p JOIN y q USING (i) GROUP BY 1, 2) SELECT round((SELECT sum(v * v) FROM xy) / sqrt((SELECT sum(v * v) FROM xx) * (SELECT sum(v * v) FROM yy)), 6) AS cka"
)
def cka_linear(s, d):
    return _value(s, "cka", metrics.cka(paired_moments(_emb(s, d))))


@query(f"WITH {E_SQL} SELECT round(avg(list_cosine_similarity(a, b)), 6) AS cosine FROM e")
def cosine_similarity(s, d):
    return _value(s, "cosine", metrics.cosine_similarity(_emb(s, d), "z1", "z2"))


@query(f"WITH {E_SQL}, x AS (SELECT unnest(a) AS x, unnest(b) AS y, generate_subscripts(a, 1) AS c FROM e) SELECT round(avg(t), 6) AS tucker FROM (SELECT abs(sum(x * y)) / sqrt(sum(x * x) * sum(y * y)) AS t FROM x GROUP BY c)")
def tucker_congruence(s, d):
    return _value(s, "tucker", metrics.tucker(paired_moments(_emb(s, d))))


@query(f"WITH {E_SQL}, x AS (SELECT unnest(a) AS x, unnest(b) AS y, generate_subscripts(a, 1) AS c FROM e) SELECT round(sqrt(sum(t * t)), 6) AS mmd FROM (SELECT avg(x) - avg(y) AS t FROM x GROUP BY c)")
def mmd_linear(s, d):
    return _value(s, "mmd", metrics.mmd_linear(paired_moments(_emb(s, d))))


@query(f"WITH {E_SQL} SELECT round(sqrt(avg((1 + list_dot_product(p.a, q.a)) ** 2 + (1 + list_dot_product(p.b, q.b)) ** 2 - 2 * (1 + list_dot_product(p.a, q.b)) ** 2)), 6) AS mmd FROM e p, e q")
def mmd_poly(s, d):
    return _value(s, "mmd", metrics.mmd_polynomial(paired_moments(_emb(s, d))))


_PAIR2 = """l AS (SELECT l_quantity / 10 AS a, l_extendedprice / 10000 AS b, l_quantity / 10 + 20 * l_discount AS c, l_extendedprice / 10000 - 30 * l_tax AS d FROM lineitem),
m AS (SELECT count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(d) AS md, covar_samp(a, a) AS aa, covar_samp(a, b) AS ab, covar_samp(b, b) AS bb, covar_samp(c, c) AS cc, covar_samp(c, d) AS cd, covar_samp(d, d) AS dd,
covar_samp(a, c) AS ac, covar_samp(a, d) AS ad, covar_samp(b, c) AS bc, covar_samp(b, d) AS bd FROM l)"""


@query(f"WITH {_PAIR2} SELECT round(sqrt(greatest(2 - 2 * sqrt(ac * ac + ad * ad + bc * bc + bd * bd + 2 * abs(ac * bd - ad * bc)) / sqrt((aa + bb) * (cc + dd)), 0)), 6) AS procrustes FROM m")
def procrustes(s, d):
    return _value(s, "procrustes", metrics.procrustes(paired_moments(_mixed(s, d))))


@query(f"WITH {_PAIR2} SELECT round(sqrt((ma - mc) ** 2 + (mb - md) ** 2 + aa + bb + cc + dd - 2 * sqrt(aa * cc + 2 * ab * cd + bb * dd + 2 * sqrt((aa * bb - ab * ab) * (cc * dd - cd * cd)))), 6) AS frechet FROM m")
def frechet(s, d):
    return _value(s, "frechet", metrics.frechet(paired_moments(_mixed(s, d))))


_EIG = "e AS (SELECT *, (aa + bb) / 2 + sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS p1, (aa + bb) / 2 - sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS p2, (cc + dd) / 2 + sqrt(((cc - dd) / 2) ** 2 + cd * cd) AS q1, (cc + dd) / 2 - sqrt(((cc - dd) / 2) ** 2 + cd * cd) AS q2 FROM m)"


@query(f"WITH {_PAIR2}, {_EIG} SELECT round(sqrt((p1 / (p1 + p2) - q1 / (q1 + q2)) ** 2 + (p2 / (p1 + p2) - q2 / (q1 + q2)) ** 2), 6) AS eigenspectrum FROM e")
def eigenspectrum(s, d):
    return _value(s, "eigenspectrum", metrics.eigenspectrum(paired_moments(_mixed(s, d))))


_EPS = "r AS (SELECT n, ma, mb, mc, md, aa + 1e-6 AS aa, ab, bb + 1e-6 AS bb, cc + 1e-6 AS cc, cd, dd + 1e-6 AS dd FROM m)"


@query(f"WITH {_PAIR2}, {_EPS}, t AS (SELECT (bb * cc - 2 * ab * cd + aa * dd) / (aa * bb - ab * ab) AS tr, (cc * dd - cd * cd) / (aa * bb - ab * ab) AS det FROM r) SELECT round(sqrt(ln(tr / 2 + sqrt(tr * tr / 4 - det)) ** 2 + ln(tr / 2 - sqrt(tr * tr / 4 - det)) ** 2), 6) AS riemannian FROM t")
def riemannian_ai(s, d):
    return _value(s, "riemannian", metrics.riemannian(paired_moments(_mixed(s, d)), "affine_invariant"))


# ln of a 2x2 SPD matrix: with eigenvalues p1, p2 it is k S + h I, k = (ln p1 - ln p2) / (p1 - p2), h = ln p1 - k p1
@query(
    f"WITH {_PAIR2}, {_EPS}, {_EIG.replace('FROM m)', 'FROM r)')}, k AS (SELECT *, (ln(p1) - ln(p2)) / (p1 - p2) AS k1, (ln(q1) - ln(q2)) / (q1 - q2) AS k2 FROM e), h AS (SELECT *, ln(p1) - k1 * p1 AS h1, ln(q1) - k2 * q1 AS h2 FROM k) "
    "SELECT round(sqrt((k1 * aa + h1 - k2 * cc - h2) ** 2 + 2 * (k1 * ab - k2 * cd) ** 2 + (k1 * bb + h1 - k2 * dd - h2) ** 2), 6) AS riemannian FROM h"
)
def riemannian_le(s, d):
    return _value(s, "riemannian", metrics.riemannian(paired_moments(_mixed(s, d))))


def _kl2(m1: str, s1: str, m2: str, s2: str) -> str:
    """SQL of the divergence of 2-D Gaussians whose columns have these prefixes."""
    a, b, c, p, q, r = (f"{x}" for x in (*s1.split(), *s2.split()))
    x, y = (f"({v} - {u})" for u, v in zip(m1.split(), m2.split(), strict=True))
    det1, det2 = f"({a} * {c} - {b} * {b})", f"({p} * {r} - {q} * {q})"
    return f"0.5 * (({r} * {a} - 2 * {q} * {b} + {p} * {c}) / {det2} + ({r} * {x} ** 2 - 2 * {q} * {x} * {y} + {p} * {y} ** 2) / {det2} - 2 + ln({det2} / {det1}))"


@query(f"WITH {_PAIR2}, {_EPS} SELECT round(greatest({_kl2('ma mb', 'aa ab bb', 'mc md', 'cc cd dd')}, 0), 6) AS kl FROM r")
def kl_divergence(s, d):
    return _value(s, "kl", metrics.kl_divergence(paired_moments(_mixed(s, d))))


@query(
    f"WITH {_PAIR2}, {_EPS}, x AS (SELECT *, (ma + mc) / 2 AS u, (mb + md) / 2 AS v, (aa + cc) / 2 + ((ma - mc) / 2) ** 2 AS p, (ab + cd) / 2 + (ma - mc) * (mb - md) / 4 AS q, (bb + dd) / 2 + ((mb - md) / 2) ** 2 AS w FROM r) "
    f"SELECT round((greatest({_kl2('ma mb', 'aa ab bb', 'u v', 'p q w')}, 0) + greatest({_kl2('mc md', 'cc cd dd', 'u v', 'p q w')}, 0)) / 2, 6) AS js FROM x"
)
def js_divergence(s, d):
    return _value(s, "js", metrics.js_divergence(paired_moments(_mixed(s, d))))


@query(
    f"WITH {_PAIR2}, t AS (SELECT ((bb * ac - ab * bc) * (dd * ac - cd * ad) + (bb * ad - ab * bd) * (cc * ad - cd * ac) + (aa * bc - ab * ac) * (dd * bc - cd * bd) + (aa * bd - ab * ad) * (cc * bd - cd * bc)) / ((aa * bb - ab * ab) * (cc * dd - cd * cd)) AS tr, "
    "((ac * bd - ad * bc) ** 2) / ((aa * bb - ab * ab) * (cc * dd - cd * cd)) AS det FROM m) SELECT round((sqrt(tr / 2 + sqrt(greatest(tr * tr / 4 - det, 0))) + sqrt(tr / 2 - sqrt(greatest(tr * tr / 4 - det, 0)))) / 2, 5) AS svcca FROM t"
)
def svcca(s, d):
    """All components (threshold 1): the mean canonical correlation."""
    return _value(s, "svcca", metrics.svcca(paired_moments(_mixed(s, d)), 1.0)).withColumn("svcca", F.round("svcca", 5))


@query("SELECT round(1 - (regr_syy(l_extendedprice, l_quantity) - 2 * b * regr_sxy(l_extendedprice, l_quantity) + b * b * regr_sxx(l_extendedprice, l_quantity)) / regr_syy(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem, (SELECT regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 1.0) AS b FROM lineitem) GROUP BY b")
def linear_r2(s, d):
    rows = _t(s, d, "lineitem").select(F.array("l_quantity").alias("z1"), F.array("l_extendedprice").alias("z2"))
    return _value(s, "r2", metrics.linear_r2(paired_moments(rows)))


@query(
    "WITH t AS (SELECT regr_sxy(l_extendedprice, l_quantity) AS xy, regr_sxx(l_extendedprice, l_quantity) AS xx, regr_syy(l_extendedprice, l_quantity) AS yy FROM lineitem) "
    "SELECT round(((2 * xy * xy / (xx + 1) - xx * (xy / (xx + 1)) ** 2) / yy + (2 * xy * xy / (yy + 1) - yy * (xy / (yy + 1)) ** 2) / xx) / 2, 6) AS r2 FROM t"
)
def bidirectional_r2(s, d):
    rows = _t(s, d, "lineitem").select(F.array("l_quantity").alias("z1"), F.array("l_extendedprice").alias("z2"))
    return _value(s, "r2", metrics.bidirectional_r2(paired_moments(rows)))


@query(
    "WITH e AS (SELECT value AS x, value + event_id % 7 AS y, floor((row_number() OVER (ORDER BY event_id) - 1) / ((SELECT count(*) FROM events) / 5))::INTEGER AS f FROM events), k AS (SELECT unnest(range(5)) AS k), "
    "t AS (SELECT k, regr_sxy(y, x) / (regr_sxx(y, x) + 1.0) AS b, avg(x) AS mx, avg(y) AS my FROM e, k WHERE f <> k GROUP BY k), r AS (SELECT k, 1 - sum((y - my - b * (x - mx)) ** 2) / (var_pop(y) * count(*)) AS r2 FROM e JOIN t ON f = k GROUP BY k) SELECT round(avg(r2), 6) AS r2 FROM r"
)
def linear_r2_cv(s, d):
    e = _t(s, d, "events").select("event_id", F.array("value").alias("z1"), F.array(F.col("value") + F.col("event_id") % 7).alias("z2"))
    return _value(s, "r2", metrics.linear_r2_cv(e, "event_id", "z1", "z2", 5))


# ---- pairs


@query(f"WITH {E_SQL}, p AS (SELECT 1 - list_cosine_similarity(p.a, q.a) AS x, 1 - list_cosine_similarity(p.b, q.b) AS y FROM e p JOIN e q ON p.i < q.i) SELECT round(corr(x, y), 6) AS correlation FROM p")
def rsa_pearson(s, d):
    return _rounded(pairs.rsa(_emb(s, d), "row_id", "z1", "z2", "pearson"), "correlation")


_RANKED = "r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM p) SELECT round(corr(x, y), 5) AS correlation FROM r"


@query(f"WITH {E_SQL}, p AS (SELECT 1 - list_cosine_similarity(p.a, q.a) AS x, 1 - list_cosine_similarity(p.b, q.b) AS y FROM e p JOIN e q ON p.i < q.i), {_RANKED}")
def rsa_spearman(s, d):
    return _rounded(pairs.rsa(_emb(s, d), "row_id", "z1", "z2", digits=5), "correlation", digits=5)


@query(f"WITH {E_SQL}, p AS (SELECT list_distance(p.a, q.a) AS x, list_distance(p.b, q.b) AS y FROM e p JOIN e q ON p.i < q.i), {_RANKED}")
def rsa_euclid(s, d):
    return _rounded(pairs.rsa(_emb(s, d), "row_id", "z1", "z2", "spearman", "euclidean", 5), "correlation", digits=5)


@query(f"WITH {E_SQL}, p AS (SELECT 1 - list_cosine_similarity(p.v, q.v) AS x, abs(p.y - q.y) AS y FROM e p JOIN e q ON p.i < q.i), {_RANKED}")
def embedding_property_corr(s, d):
    return _rounded(probes.embedding_property_correlation(_emb(s, d), "row_id", "embedding", "y", 5), "correlation", digits=5)


@query(f"WITH {E_SQL} SELECT round(sqrt(greatest(avg(exp(-0.5 * list_distance(p.a, q.a) ** 2) + exp(-0.5 * list_distance(p.b, q.b) ** 2) - 2 * exp(-0.5 * list_distance(p.a, q.b) ** 2)), 0)), 6) AS mmd FROM e p, e q")
def mmd_rbf(s, d):
    return _value(s, "mmd", pairs.mmd_rbf(_emb(s, d), "row_id", "z1", "z2", 0.5))


@query(
    f"WITH {E_SQL}, k AS (SELECT p.i, q.i AS j, exp(-0.5 * list_distance(p.a, q.a) ** 2) AS k, exp(-0.5 * list_distance(p.b, q.b) ** 2) AS l FROM e p, e q), c AS (SELECT k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k, l - avg(l) OVER (PARTITION BY i) - avg(l) OVER (PARTITION BY j) + avg(l) OVER () AS l FROM k) "
    "SELECT round(sum(k * l) / sqrt(sum(k * k) * sum(l * l)), 6) AS cka FROM c"
)
def cka_rbf(s, d):
    return _value(s, "cka", pairs.cka_rbf(_emb(s, d), "row_id", "z1", "z2", 0.5))


@query(
    "WITH e AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), p AS (SELECT p.i, q.i AS j, greatest(abs(p.a - q.a), abs(p.b - q.b)) AS dx, greatest(abs(p.b - q.b), abs(p.c - q.c)) AS dy FROM e p JOIN e q ON p.i <> q.i), "
    "r AS (SELECT i, d AS eps FROM (SELECT i, greatest(dx, dy) AS d, row_number() OVER (PARTITION BY i ORDER BY greatest(dx, dy)) AS r FROM p) WHERE r = 3), n AS (SELECT i, count(*) FILTER (dx <= eps + 1e-10) AS nx, count(*) FILTER (dy <= eps + 1e-10) AS ny FROM p JOIN r USING (i) GROUP BY i), "
    "h AS (SELECT m, -0.5772156649015329 + coalesce(sum(1.0 / m) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS psi FROM (SELECT unnest(range(1, (SELECT count(*) FROM e) + 1)) AS m)) "
    "SELECT round(greatest((SELECT psi FROM h WHERE m = 3) - avg(u.psi + w.psi) + (SELECT psi FROM h WHERE m = (SELECT count(*) FROM e)), 0), 6) AS mi FROM n JOIN h u ON u.m = nx + 1 JOIN h w ON w.m = ny + 1"
)
def mutual_information(s, d):
    e = _t(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("z1"), F.slice("embedding", 2, 2).alias("z2"))
    return _value(s, "mi", pairs.mutual_information(e, "vec_id", "z1", "z2", 3))


@query(
    f"WITH {E_SQL}, c AS (SELECT greatest(-1, least(0.9999999, list_cosine_similarity(p.a, q.a))) AS x FROM e p JOIN e q ON p.i < q.i) SELECT floor((x + 1) * 50)::INTEGER AS bin, count(*)::BIGINT AS n FROM c GROUP BY 1"
)
def histogram_100(s, d):
    return pairs.cosine_histogram(_emb(s, d), "row_id", "z1")


# ---- cleaning, probes and shape


@query("WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events) SELECT event_id, value FROM events, q WHERE value BETWEEN lo AND hi")
def clean_inputs(s, d):
    return probes.clean(_t(s, d, "events").select("event_id", "value"), "value")


@query("WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events WHERE value > 0) SELECT event_id, round(greatest(lo, least(hi, value)), 6) AS value FROM events, q WHERE value > 0")
def prep_property(s, d):
    return _rounded(probes.winsorise(_t(s, d, "events").select("event_id", "value"), "value", keep=F.col("value") > 0), "value")


@query("WITH f AS (SELECT event_type AS property, user_id % 5 AS fold, avg(value) AS r2 FROM events GROUP BY ALL), g AS (SELECT property, avg(r2) AS m, var_samp(r2) AS v, count(*) AS f FROM f GROUP BY property) SELECT round(avg(m), 6) AS grand_mean, round(sqrt(sum(v / f)) / count(*), 6) AS standard_error, count(*)::BIGINT AS properties FROM g")
def probe_summary_se(s, d):
    folds = _t(s, d, "events").groupBy(F.col("event_type").alias("property"), (F.col("user_id") % 5).alias("fold")).agg(F.avg("value").alias("r2"))
    return _rounded(probes.probe_summary(folds), "grand_mean", "standard_error")


@query()
def linear_probe(s, d):
    r = probes.linear_probe(_emb(s, d), "row_id", "z1", "y")
    return s.createDataFrame([(round(r["mean"], 6), round(r["std"], 6))], "mean double, std double")


@query()
def nonlinear_probe(s, d):
    r = probes.nonlinear_probe(_emb(s, d), "z1", "y", "row_id", 2, 5, 3)
    return s.createDataFrame([(r["mean"], r["std"])], "mean double, std double")


@query()
def published_probe(s, d):
    r = probes.random_split_probe(_emb(s, d), "row_id", "z1", "y", 10, 100)
    return s.createDataFrame([(r["mean"], r["std"], r["n"])], "mean double, std double, n long")


@query()
def shape_stats(s, d):
    return shape.shape_statistics(_emb(s, d), "row_id", "embedding")


@query(f"WITH {E_SQL} SELECT round(avg(list_cosine_similarity(p.v, q.v)), 6) AS anisotropy FROM e p JOIN e q ON p.i < q.i")
def anisotropy(s, d):
    """Mean cosine of all pairs, from the sum of unit vectors alone."""
    return _value(s, "anisotropy", shape.anisotropy(_emb(s, d), "embedding"))


@query()
def calibrated_pair(s, d):
    return shape.calibrate_cka_mknn(_emb(s, d), "row_id", "z1", "z2", 10, 1000)


@query()
def compare_all(s, d):
    return metrics.compare(_emb(s, d), "row_id", "z1", "z2")


@query()
def compare_unequal(s, d):
    """Metrics that need equal dimensions give null here."""
    return metrics.compare(_emb(s, d, 16, 48), "row_id", "z1", "z2", ["procrustes", "cka", "frechet", "tucker_congruence"])


@query("SELECT round(1 - corr(l_quantity, l_extendedprice) ** 2, 6) AS disparity FROM lineitem")
def disparity_1d(s, d):
    return _rounded(_t(s, d, "lineitem").agg((1 - F.corr("l_quantity", "l_extendedprice") ** 2).alias("disparity")), "disparity")


# ---- relational work


@query("WITH a AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS mean_score, max(c_acctbal) AS max_score, count(*) AS n_scores FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY mean_score DESC, c_mktsegment) AS r FROM a) SELECT c_nationkey, c_mktsegment, round(mean_score, 6) AS mean_score, max_score, n_scores, round(mean_score, 6) AS mean_value, n_scores::DOUBLE AS row_count FROM r WHERE r <= 3")
def candidates_topk(s, d):
    c = _t(s, d, "customer")
    scores = c.select("c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("score"))
    g = c.groupBy("c_nationkey", "c_mktsegment")
    shapes = g.agg(F.avg("c_acctbal").alias("value")).withColumn("statistic", F.lit("mean_value")).unionByName(g.agg(F.count("*").cast("double").alias("value")).withColumn("statistic", F.lit("row_count")))
    return _rounded(relational.candidates(scores, shapes, ["c_nationkey"], "c_mktsegment"), "mean_score", "mean_value")


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'a' WHEN o_orderpriority LIKE '1%' THEN 'b' ELSE 'c' END AS part FROM orders")
def merge_partials_dedupe(s, d):
    o = _t(s, d, "orders")
    parts = [o.where(w).select("o_orderkey", "o_totalprice", F.lit(p).alias("part")) for p, w in (("a", "o_orderstatus = 'F'"), ("b", "o_orderpriority like '1%'"), ("c", "true"))]
    return relational.merge_partials(parts, ["o_orderkey"], "o_totalprice")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0 AND doc_id % 10 < 5)")
def pending_tasks(s, d):
    l = _t(s, d, "labels")
    done, running = l.where("quality = 1").select("doc_id"), l.where("toxic = 0").select("doc_id", F.when(F.col("doc_id") % 10 < 5, 10.0).otherwise(9999.0).alias("age_s"))
    return relational.pending(_t(s, d, "documents").select("doc_id"), done, running, ["doc_id"])


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 4) AS p1, round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1")
def band_percentiles(s, d):
    found = percentiles(_t(s, d, "lineitem"), "l_extendedprice", [0.01, 0.05, 0.99], ("l_returnflag",))
    return _rounded(s.createDataFrame([(*k, *q) for k, q in found.items()], "l_returnflag string, p1 double, p5 double, p99 double"), "p1", "p5", "p99", digits=4)


@query(
    "WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem GROUP BY 1) SELECT l_returnflag, least(255, floor(255 * greatest(0.0, least(1.0, asinh(20 * (l_extendedprice - lo) / (hi - lo)) / asinh(20.0)))))::INTEGER AS level, count(*)::BIGINT AS n FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1, 2"
)
def arcsinh_stretch(s, d):
    l = _t(s, d, "lineitem")
    found = percentiles(l, "l_extendedprice", [0.01, 0.99], ("l_returnflag",))
    q = s.createDataFrame([(*k, q) for k, q in found.items()], "l_returnflag string, q array<double>")
    x = arrays.arcsinh_stretch(F.col("l_extendedprice"), F.col("q")[0], F.col("q")[1])
    return l.join(F.broadcast(q), "l_returnflag").groupBy("l_returnflag", F.least(F.lit(255), F.floor(255 * x)).cast("int").alias("level")).agg(F.count("*").alias("n"))


@query("SELECT event_id, value FROM events WHERE event_id < 500 AND value > 50")
def limit_then_filter(s, d):
    return _t(s, d, "events").where("event_id < 500").where("value > 50").select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE value > 50 ORDER BY event_id LIMIT 100")
def filter_then_limit(s, d):
    return _t(s, d, "events").where("value > 50").orderBy("event_id").limit(100).select("event_id", "value")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def majority_filter(s, d):
    return relational.majority_rows(_t(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("SELECT user_id, event_id, value, next_value FROM (SELECT user_id, event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value FROM events) WHERE next_value IS NOT NULL")
def adjacent_pairs(s, d):
    return relational.adjacent(_t(s, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "value", "next_value")


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority LIKE '1%')::BIGINT AS urgent, count(*) FILTER (o_orderpriority LIKE '2%')::BIGINT AS high FROM orders GROUP BY 1")
def pivot_counts(s, d):
    o = _t(s, d, "orders").withColumn("p", F.substring("o_orderpriority", 1, 1))
    return o.groupBy("o_orderstatus").pivot("p", ["1", "2"]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"1": "urgent", "2": "high"})


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, -1)::INTEGER AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_labels(s, d):
    return _t(s, d, "documents").select("doc_id", "lang").join(_t(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0 AND l_discount > 0 THEN -2.5 * log10(l_tax / l_discount) END, 6) + 0.0 AS colour, CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS unflagged, CASE WHEN l_quantity > 10 THEN l_quantity END AS above FROM lineitem")
def colour_label(s, d):
    t, x = F.col("l_tax"), F.col("l_discount")
    c = F.when((t > 0) & (x > 0), -2.5 * F.log10(t / x))
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.round(c, 6) + F.lit(0.0)).alias("colour"), F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("unflagged"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("above"))


@query("SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_name LIKE 'N%' OR r_name LIKE '%A'")
def string_predicates(s, d):
    r, n = _t(s, d, "region"), _t(s, d, "nation")
    return r.join(F.broadcast(n), r.r_regionkey == n.n_regionkey).where(F.col("n_name").startswith("N") | F.col("r_name").endswith("A")).select("r_name", "n_name")


@query("SELECT a.p_brand AS brand_a, b.p_brand AS brand_b, round(a.m - b.m, 6) AS gap FROM (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY 1) a JOIN (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY 1) b ON a.p_brand < b.p_brand")
def model_pairs(s, d):
    m = _t(s, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    a, b = m.select(F.col("p_brand").alias("brand_a"), F.col("m").alias("x")), m.select(F.col("p_brand").alias("brand_b"), F.col("m").alias("y"))
    return _rounded(a.join(b, F.col("brand_a") < F.col("brand_b")).select("brand_a", "brand_b", (F.col("x") - F.col("y")).alias("gap")), "gap")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def metadata_upsert(s, d):
    t = _t(s, d, "supplier").select("s_suppkey", "s_acctbal")
    return relational.upsert(t, t.where("s_suppkey % 4 = 0").withColumn("s_acctbal", F.lit(0.0)), ["s_suppkey"])
