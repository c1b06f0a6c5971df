"""Exact nearest-neighbour edges and what is computed from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays
from .blocks import against_all
from .moments import matrix
from .quantiles import percentile_list


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Pairwise distances of rows, one column of differences at a time where no product form is exact."""
    if metric == "cosine":
        nx, ny = (np.linalg.norm(z, axis=1) for z in (x, y))
        return 1 - (x / np.where(nx < 1e-12, 1, nx)[:, None]) @ (y / np.where(ny < 1e-12, 1, ny)[:, None]).T
    if metric == "inner":
        return -(x @ y.T)
    total = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T, strict=True):
        gap = np.abs(a[:, None] - b)
        if metric == "chebyshev":
            np.maximum(total, gap, out=total)
        elif metric in ("euclidean", "sqeuclidean"):
            total += gap * gap
        elif metric == "cityblock":
            total += gap
        else:
            raise ValueError(f"unknown metric {metric}")
    return np.sqrt(total) if metric == "euclidean" else total


#: Rows of the right side that a block of left rows is compared with at a time.
CHUNK = 4096


def product_form(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Squared Euclidean distances by one matrix product and a bound of their error; None where values are too large or not finite."""
    shift = y.mean(axis=0)
    x, y = x - shift, y - shift
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    most = (np.sqrt(xx.max(initial=0)) + np.sqrt(yy.max(initial=0)) + 2 * np.abs(shift).max(initial=0)) ** 2
    if not np.isfinite(most):
        return None
    d = x @ y.T
    d *= -2
    d += xx[:, None]
    d += yy
    return d, 4 * (x.shape[1] + 8) * np.finfo(float).eps * float(most)


def nearest_euclidean(li: np.ndarray, x: np.ndarray, ri: np.ndarray, y: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """(i, j, dist) of the k nearest other rows, by distance and then j: product forms leave what may be near, exact distances decide."""
    held = pd.DataFrame({"i": li[:0], "j": ri[:0], "dist": np.empty(0), "row": np.empty(0, np.int64)})
    cut = np.full(len(li), np.inf)  # squared, of the k-th so far
    for s in range(0, len(ri), CHUNK):
        j, z = ri[s : s + CHUNK], y[s : s + CHUNK]
        found = product_form(x, z)
        if found is None:
            a, b = np.nonzero(li[:, None] != j)
        else:
            d, error = found
            own = li[:, None] == j
            d[own] = np.inf
            m = min(k, len(j))
            bound = cut if np.isfinite(cut).all() else np.minimum(cut, np.partition(d, m - 1, axis=1)[:, m - 1] + error if m == k else np.inf)
            near = d <= (bound * (1 + 1e-12) + error)[:, None]
            near &= ~own
            a, b = np.nonzero(near)
        if not len(a):
            continue
        exact = np.empty(len(a))
        for c in range(0, len(a), 1 << 16):  # column by column, as distances() adds them
            p, q = x[a[c : c + (1 << 16)]], z[b[c : c + (1 << 16)]]
            total = np.zeros(len(p))
            for u, v in zip(p.T, q.T, strict=True):
                gap = u - v
                total += gap * gap
            exact[c : c + (1 << 16)] = np.sqrt(total) if metric == "euclidean" else total
        fine = np.isfinite(exact)
        new = pd.DataFrame({"i": li[a], "j": j[b], "dist": exact, "row": a})[fine]
        held = pd.concat([held, new]).sort_values(["row", "dist", "j"], kind="stable") if len(held) else new.sort_values(["row", "dist", "j"], kind="stable")
        place = held.groupby("row").cumcount()
        held = held[place < k]
        last = held[place[place < k] == k - 1]
        cut[last["row"].to_numpy()] = last["dist"].to_numpy() ** (2 if metric == "euclidean" else 1)
    return held[["i", "j", "dist"]]


def knn_edges(df: DataFrame, row_id: str, vector: str, k: int = 10, metric: str = "cosine", **options) -> DataFrame:
    """(i, j, rank, dist): the k nearest other rows of each row, equal distances by the smaller id."""
    if metric not in ("cosine", "inner", "chebyshev", "euclidean", "sqeuclidean", "cityblock"):
        raise ValueError(f"unknown metric {metric}")

    def nearest(li: np.ndarray, lm: list, ri: np.ndarray, rm: list) -> pd.DataFrame:
        if metric in ("euclidean", "sqeuclidean"):
            return nearest_euclidean(li, lm[0], ri, rm[0], k, metric)
        d = distances(lm[0], rm[0], metric)
        d[li[:, None] == ri] = np.inf
        m = min(k, len(ri))
        cut = np.partition(d, m - 1, axis=1)[:, m - 1 : m]  # all that tie with the last stay until the order decides
        a, b = np.nonzero((d <= cut) & np.isfinite(d))
        out = pd.DataFrame({"i": li[a], "j": ri[b], "dist": d[a, b]}).sort_values(["i", "dist", "j"])
        return out.groupby("i").head(k)

    found = against_all(df, row_id, [vector], nearest, "i long, j long, dist double", **options)
    rank = F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("i", "j", F.col("rank").cast("int").alias("rank"), "dist")


def knn_edges_approximate(df: DataFrame, row_id: str, vector: str, k: int = 10, lists: int | None = None, probes: int = 16, stored: int = 2, most_lists: int = 16_384, block: int = 1024) -> DataFrame:
    """(i, j, rank, dist): about the k nearest by cosine, from the lists of nearest reference vectors; work grows with n^1.5.

    References are about sqrt(n) rows with the smallest hashes. A row is stored in the lists of its `stored` nearest and looked
    up in those of its `probes` nearest; with probes = lists the result is exact. Lists beyond a block are dealt as pairs of blocks.
    """
    spark = df.sparkSession
    rows = df.select(F.col(row_id).alias("i"), arrays.doubles(F.col(vector)).alias("v")).where("v is not null and size(v) > 0")
    m = lists or min(most_lists, math.ceil(math.sqrt(max(1, rows.count()))))
    some = np.array([r.v for r in rows.orderBy(F.xxhash64("i"), "i").limit(m).collect()])  # bounded by most_lists
    if not len(some):
        return spark.createDataFrame([], "i long, j long, rank int, dist double")
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) < 1e-12, 1.0, n)
    shared, seen = spark.sparkContext.broadcast(unit(some)), min(probes, len(some))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column("v")))
            near = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :seen].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(list(x)), pa.array(list(near))], names=["i", "v", "near"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            every = pa.concat_batches(held)
            asks = every.column("asks").to_numpy(zero_copy_only=False)
            i, x = every.column("i").to_numpy(), matrix(every.column("v"))
            d = 1 - x[asks] @ x[~asks].T
            d[i[asks][:, None] == i[~asks]] = np.inf
            cut = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1 :][:, :1] if d.size else np.empty((len(d), 1))
            a, b = np.nonzero((d <= cut) & np.isfinite(d))
            return pa.RecordBatch.from_arrays([pa.array(i[asks][a]), pa.array(i[~asks][b]), pa.array(d[a, b])], names=["i", "j", "dist"])

        last = None
        for batch in batches:
            task = batch.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a and held and task[a] != last:
                    yield done()
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
                    last = task[a]
        if held:
            yield done()

    described = rows.mapInArrow(describe, "i long, v array<double>, near array<int>")
    stores = described.select("i", "v", F.explode(F.slice("near", 1, stored)).alias("list"))
    asks = described.select("i", "v", F.explode("near").alias("list"))
    count = lambda t, out: t.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias(out))
    sizes = F.broadcast(count(stores, "m").join(count(asks, "q"), "list"))  # a row for each list
    own = lambda n: F.pmod(F.xxhash64("i"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = stores.join(sizes, "list").select("list", "i", "v", F.lit(False).alias("asks"), own("m").alias("mb"), other("q").alias("qb"))
    dealt = dealt.unionByName(asks.join(sizes, "list").select("list", "i", "v", F.lit(True).alias("asks"), own("q").alias("qb"), other("m").alias("mb")))
    dealt = dealt.select(F.xxhash64("list", "mb", "qb").alias("task"), "i", "v", "asks").repartition("task").sortWithinPartitions("task")
    found = dealt.mapInArrow(compare, "i long, j long, dist double").groupBy("i", "j").agg(F.min("dist").alias("dist"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("i", "j", F.col("rank").cast("int").alias("rank"), "dist")


def knn_edges_sql(df: DataFrame, row_id: str, vector: str, k: int = 10) -> DataFrame:
    """The cosine edges as expressions only (a cross-check for tests; quadratic rows)."""
    v = df.select(F.col(row_id).alias("i"), arrays.doubles(F.col(vector)).alias("a"))
    pairs = v.crossJoin(v.select(F.col("i").alias("j"), F.col("a").alias("b"))).where("i <> j").select("i", "j", (1 - arrays.cosine(F.col("a"), F.col("b"))).alias("dist"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))).where(F.col("rank") <= k)


def effective_k(n: int, k: int) -> int:
    return k if k < n else max(1, n - 1)


def overlap(edges1: DataFrame, edges2: DataFrame, k: int) -> DataFrame:
    """(i, shared): how many neighbours two graphs have in common in each row, rows with none too."""
    both = edges1.select("i", "j").join(edges2.select("i", "j"), ["i", "j"]).groupBy("i").agg(F.count("*").alias("shared"))
    return edges1.select("i").distinct().join(both, "i", "left").select("i", F.coalesce("shared", F.lit(0)).alias("shared"))


def mknn_from_edges(edges1: DataFrame, edges2: DataFrame, k: int) -> DataFrame:
    return overlap(edges1, edges2, k).agg((F.sum("shared") / (F.count("*") * k)).alias("mknn"))


def jaccard_from_edges(edges1: DataFrame, edges2: DataFrame, k: int) -> DataFrame:
    return overlap(edges1, edges2, k).agg(F.avg(F.col("shared") / (2 * k - F.col("shared"))).alias("jaccard"))


def truncate_outliers(df: DataFrame, vector: str, percentile: float) -> DataFrame:
    """Clips every cell to plus or minus the percentile of absolute values over all cells."""
    cell = df.select(F.explode(F.transform(arrays.doubles(F.col(vector)), F.abs)).alias("x"))
    bound = percentile_list(cell.where(~F.isnan("x")), "x", [percentile / 100])
    return df.withColumn(vector, arrays.clipped(arrays.doubles(F.col(vector)), F.lit(-bound[0]), F.lit(bound[0]))) if bound else df


def neighbour_values(edges: DataFrame, values: DataFrame, row_id: str, value: str) -> DataFrame:
    """Edges with the neighbour's value."""
    return edges.join(values.select(F.col(row_id).alias("j"), F.col(value).alias("value")), "j")


def property_consistency(edges: DataFrame, values: DataFrame, row_id: str, value: str) -> DataFrame:
    """Mean over rows of the spread of the neighbours' values, against the overall spread."""
    local = neighbour_values(edges, values, row_id, value).groupBy("i").agg(F.stddev_pop("value").alias("s")).agg(F.avg("s").alias("local"))
    total = values.agg(F.stddev_pop(value).alias("overall"))
    return local.crossJoin(total).select(F.when(F.col("overall") >= 1e-12, F.col("local") / F.col("overall")).alias("consistency"))


def neighbour_wasserstein(edges1: DataFrame, edges2: DataFrame, values: DataFrame, row_id: str, value: str) -> DataFrame:
    """(i, distance) between the values of a row's neighbours in two graphs of equal k."""
    side = lambda e, name: neighbour_values(e, values, row_id, value).groupBy("i").agg(F.collect_list("value").alias(name))
    both = side(edges1, "a").join(side(edges2, "b"), "i")
    return both.select("i", arrays.sorted_gap(F.col("a"), F.col("b")).alias("distance"))


def two_nn_local(edges: DataFrame) -> DataFrame:
    """(i, dimension): ln 2 / ln(r2 / r1) of the first two neighbours; null if undefined."""
    r = edges.where("rank <= 2").groupBy("i").agg(F.max(F.when(F.col("rank") == 1, F.col("dist"))).alias("r1"), F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("r2"))
    return r.select("i", F.when((F.col("r1") > 0) & (F.col("r2") / F.col("r1") > 1), F.log(F.lit(2.0)) / F.log(F.col("r2") / F.col("r1"))).alias("dimension"))


def two_nn_global(edges: DataFrame) -> DataFrame:
    r = edges.where("rank <= 2").groupBy("i").agg(F.max(F.when(F.col("rank") == 1, F.col("dist"))).alias("r1"), F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("r2"))
    kept = r.where("r1 > 1e-12 and r2 > r1").agg(F.count("*").alias("n"), F.sum(F.log(F.col("r2") / F.col("r1"))).alias("s"))
    return kept.select(F.when(F.col("n") > 10, F.col("n") / F.col("s")).alias("dimension"))


def knn_purity(edges: DataFrame, values: DataFrame, row_id: str, value: str, bins: int = 20) -> DataFrame:
    """(i, purity): the share of neighbours in the row's own quantile bin; right-open bins, outer edges widened by 1e-9."""
    q = [k / bins for k in range(bins + 1)]
    v = F.col(value)
    enough = values.where(v.isNotNull()).count() >= 5 * bins
    edges_of = percentile_list(values, value, q) if enough else [0.0] * (bins + 1)
    inner = F.size(F.filter(F.lit(edges_of[1:-1]), lambda e: e <= v))
    binned = values.where(v.isNotNull() & F.lit(enough)).select(F.col(row_id).alias("i"), inner.alias("bin"))
    pairs = edges.select("i", "j").join(binned, "i").join(binned.select(F.col("i").alias("j"), F.col("bin").alias("other")), "j")
    return pairs.groupBy("i").agg(F.avg(F.when(F.col("bin") == F.col("other"), 1.0).otherwise(0.0)).alias("purity"))
