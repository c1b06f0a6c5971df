"""Exact percentiles of a column of any size, without a task that holds all its distinct values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def percentiles(df: DataFrame, value: str, qs: list[float], keys: tuple[str, ...] = ()) -> dict[tuple, list[float]]:
    """{key: [linearly interpolated percentile (0 to 1) for each of qs]} of the non-null values; a key without values is absent.

    Distinct values are counted and dealt in ranges. Counts of the ranges tell which range holds a wanted place, and
    only the values at those places come back: two for each key and percentile, so keys must be few.
    """
    spark = df.sparkSession
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("_v")).where("_v is not null")
    counts = rows.groupBy(*names, "_v").agg(F.count("*").alias("_c"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = counts.repartitionByRange(ranges, *names, "_v").withColumn("_p", F.spark_partition_id()).persist()
    try:
        held: dict[tuple, list[tuple[int, int]]] = {}
        for r in parts.groupBy("_p", *names).agg(F.sum("_c").alias("_n")).orderBy("_p").collect():  # a row per range and key in it
            held.setdefault(tuple(r[n] for n in names), []).append((r["_p"], r["_n"]))
        order = list(held)
        wanted = {(g, place) for g, key in enumerate(order) for q in qs for place in _places(sum(n for _, n in held[key]), q)[:2]}
        targets = []
        for g, place in wanted:
            left = place
            for part, n in held[order[g]]:
                if left < n:
                    targets.append((part, left, g, place, *order[g]))
                    break
                left -= n
        if not targets:
            return {}
        kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
        schema = "_tp int, _at long, _g int, _place long" + "".join(f", _t{n} {kinds[n]}" for n in names)
        want = F.broadcast(spark.createDataFrame(targets, schema))  # two rows for each key and percentile
        end = F.sum("_c").over(Window.partitionBy("_p", *names).orderBy("_v"))
        on = (F.col("_p") == F.col("_tp")) & (F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_c"))
        for n in names:
            on &= F.col(n).eqNullSafe(F.col(f"_t{n}"))
        found = {(r["_g"], r["_place"]): r["_v"] for r in parts.withColumn("_end", end).join(want, on).select("_g", "_place", "_v").collect()}
    finally:
        parts.unpersist()
    out = {}
    for g, key in enumerate(order):
        n = sum(m for _, m in held[key])
        out[key] = []
        for q in qs:
            low, high, at = _places(n, q)
            a, b = found[g, low], found[g, high]
            out[key].append(a if a == b else (high - at) * a + (at - low) * b)
    return out


def _places(n: int, q: float) -> tuple[int, int, float]:
    at = (n - 1) * q
    return math.floor(at), math.ceil(at), at


def percentile_list(df: DataFrame, value: str, qs: list[float]) -> list[float] | None:
    """The percentiles of the whole column; None without values."""
    return percentiles(df, value, qs).get(())
