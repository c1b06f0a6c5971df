"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, thinned so that no two are close: a dense
group keeps one or few, however large it is. A vector's home is its nearest pivot. It is described by all
pivots that can be the home of a vector within the threshold (beyond the bisector of home and pivot by no
more than the threshold's angle), so none of its links is missed; where those are too many (far from all
pivots) by its nearest pivots. Inverted lists hold, for each pivot, the vectors with it in their
description. The vectors of a list are verified by their exact cosine; the list of the smallest shared
pivot answers for a pair, so each pair counts once. Equal vectors enter the index once, with their number.
Lists larger than a block are dealt as pairs of blocks to many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Scratch, partitions, read_table
from ._graph import connected_components
from .near_dedup import grouped


def _rows(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def spread(units: np.ndarray, apart: float) -> np.ndarray:
    """Of unit vectors, in order, those with a cosine below apart to all taken before."""
    free, taken = np.ones(len(units), bool), []
    for i in range(len(units)):
        if free[i]:
            taken.append(i)
            free &= units @ units[i] < apart
    return units[taken]


def _describe(pivots: np.ndarray, keep: int, threshold: float, apart: float):
    """Unit vectors with the numbers of the pivots that can be home to a link, if at most keep, else of their nearest; the nearest first."""
    reach = math.sqrt(1 - threshold * threshold) + 1e-9 if threshold > 0 else math.inf
    close = reach * math.sqrt(max(2 - 2 * apart, 0))  # a pivot so little behind the nearest is always within reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                v = _rows(batch.column("vector"))
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                c = v @ pivots.T
                k = min(keep, len(pivots))
                near = np.argpartition(-c, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(c, near, 1), axis=1, kind="stable"), 1).astype(np.int32)
                order = list(near)
                best = c[np.arange(len(v)), near[:, 0]]
                few = np.flatnonzero((c > (best - close)[:, None]).sum(1) <= keep)
                for s in range(0, len(few), 256):
                    x = few[s : s + 256]
                    home = near[x, 0]
                    gap = np.sqrt(np.maximum(2 - 2 * (pivots[home] @ pivots.T), 0))
                    able = best[x, None] - c[x] <= reach * gap
                    able[np.arange(len(x)), home] = True
                    for r in np.flatnonzero(able.sum(1) <= keep).tolist():
                        order[x[r]] = np.concatenate([home[r : r + 1], np.setdiff1d(np.flatnonzero(able[r]), home[r])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep"), batch.column("copies"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(order, pa.list_(pa.int32()))], names=["rep", "copies", "unit", "order"]
                )

    return run


def _compare(threshold: float, shared: int):
    """Within a task of a list: how many vectors each links with, and links that span them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "task"):
            pivot, same = group.column("pivot")[0].as_py(), group.column("same")[0].as_py()
            rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
            unit = _matrix(group.column("unit"), np.float64)
            lists = group.column("order").to_pylist()
            order = np.full((len(lists), max(map(len, lists))), -1, np.int32)  # filled up with -1
            for r, x in enumerate(lists):
                order[r, : len(x)] = x
            side = group.column("side").to_numpy(zero_copy_only=False)
            left, right = (np.arange(len(rep)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            links = np.zeros(len(rep), np.int64)
            top = np.arange(len(rep))
            a_out, b_out = [], []
            for s in range(0, len(left), 512):
                x = left[s : s + 512]
                i, j = np.nonzero(unit[x] @ unit[right].T >= threshold)
                i, j = x[i], right[j]
                ok = i < j if same else np.ones(len(i), bool)
                i, j = i[ok], j[ok]
                for t in range(0, len(i), 1 << 16):
                    p, q = i[t : t + (1 << 16)], j[t : t + (1 << 16)]
                    both = (order[p][:, :, None] == order[q][:, None, :]).any(2) & (order[p] >= 0)
                    own = np.where(both, order[p], np.iinfo(np.int32).max).min(1) == pivot
                    ok = (both.sum(1) >= shared) & own
                    p, q = p[ok], q[ok]
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    while len(p):  # keep one link for each new connection
                        ra, rb = top[p], top[q]
                        new = ra != rb
                        p, q = p[new], q[new]
                        if not len(p):
                            break
                        u, v = int(p[0]), int(q[0])
                        a_out.append(int(rep[u]))
                        b_out.append(int(rep[v]))
                        top[top == top[v]] = top[u]
                        p, q = p[1:], q[1:]
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep[some], np.array(a_out, np.int64)])), pa.array(np.concatenate([links[some], np.zeros(len(a_out), np.int64)])), pa.array([None] * len(some) + b_out, pa.int64())],
                names=["rep", "links", "other"],
            )

    return run


def near_vectors(vectors: DataFrame, *, threshold: float = 0.9, per_list: int = 512, keep: int = 8, shared: int = 1, pivots: int | None = None, most_pivots: int = 16384, apart: float = 0.8, block: int = 2048) -> DataFrame:
    """vectors (vec_id long, embedding array<float>, ...) -> vec_id, n_links, component_id, kept; one row per row.

    Links pairs found by the index with cosine >= threshold in double precision. Null, empty and zero
    vectors and those with a null or non-finite component link with nothing and are their own component;
    vectors of different dimensions never link. A null vec_id links as any other and names no component that
    has another; kept is vec_id <=> component_id. Rows that repeat a vec_id are vectors of their own with that
    id. Extra columns are ignored; an empty table gives no rows.
    The number of pivots follows the number of vectors (about `per_list` a list), up to `most_pivots`; of
    pivots with a cosine of `apart` or more one stays. `shared` above 1 drops pairs that share fewer pivots.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    e = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(e, lambda x: x != 0), F.lit(False))
    # zeros of either sign are equal; scaling keeps the largest component at 1, so that norms neither overflow nor vanish
    largest = F.array_max(F.transform(e, F.abs))
    rows = vectors.select("vec_id", F.when(fine, F.transform(e, lambda x: x / largest + F.lit(0.0))).alias("vector"))
    has = F.col("vector").isNotNull()
    # equal vectors: equal 128 bits, two hashes with different seeds
    rows = scratch.table(rows.withColumns({"key_a": F.when(has, F.xxhash64(F.lit(1), "vector")), "key_b": F.when(has, F.xxhash64(F.lit(2), "vector"))}), "rows")
    keys = ["key_a", "key_b"]
    classes = rows.where("key_a is not null").groupBy(*keys).agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    classes = scratch.table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    results = []
    for (width,) in classes.select(F.size("vector")).distinct().collect():
        own = classes.where(F.size("vector") == width)
        n = own.count()
        m = pivots or min(most_pivots, max(16, math.ceil(n * keep / per_list)))
        chosen = own.orderBy(*keys).limit(m).select("vector").collect()  # bounded by most_pivots
        p = np.array([r.vector for r in chosen], np.float64)
        p = spread(p / np.linalg.norm(p, axis=1, keepdims=True), apart)
        described = scratch.table(own.select("rep", "copies", "vector").mapInArrow(_describe(p, keep, threshold, apart), "rep long, copies long, unit binary, order array<int>"), f"described{width}")
        posts = described.withColumn("pivot", F.explode("order"))
        size = F.broadcast(posts.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))  # a row per pivot
        posts = posts.join(size, "pivot").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        tasks = posts.withColumn("theirs", others).withColumn("lo", F.least("mine", "theirs")).withColumn("hi", F.greatest("mine", "theirs"))
        tasks = tasks.withColumn("task", F.xxhash64("pivot", "lo", "hi")).withColumn("side", (F.col("mine") == F.col("hi")).cast("int")).withColumn("same", F.expr("lo = hi"))
        tasks = tasks.select("task", "pivot", "same", "side", "rep", "copies", "unit", "order").repartition(partitions(spark), "task").sortWithinPartitions("task", "rep")
        results.append(scratch.table(tasks.mapInArrow(_compare(threshold, min(shared, len(p), keep)), "rep long, links long, other long"), f"found{width}"))
    if not results:
        results = [spark.createDataFrame([], "rep long, links long, other long")]
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")), scratch).select(F.col("id").alias("rep"), "component")
    parts = parts.join(classes.select("rep", "low"), "rep")
    parts = parts.join(parts.groupBy("component").agg(F.min("low").alias("c")), "component").select("rep", "c", F.lit(True).alias("linked"))
    top = classes.select(*keys, "rep", "low", "copies").join(links, "rep", "left").join(parts, "rep", "left")
    top = top.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.when(F.col("linked"), F.col("c")).otherwise(F.col("low")).alias("c"))
    out = rows.select("vec_id", *keys).join(top, keys, "left")
    component = F.when(F.col("key_a").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
n AS (SELECT a, count(*) AS n FROM s GROUP BY a),
r AS (WITH RECURSIVE w(a, b) AS (SELECT a, b FROM s UNION SELECT w.a, s.b FROM w JOIN s ON w.b = s.a) SELECT a, min(b) AS c FROM w GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(r.c, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(r.c, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN r ON r.a = e.vec_id
"""
