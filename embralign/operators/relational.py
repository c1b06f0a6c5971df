"""The relational work around the metrics: candidates, merges, queues, pairs of models, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def candidates(scores: DataFrame, shapes: DataFrame, keys: list[str], block: str, k: int = 3) -> DataFrame:
    """Mean, best and number of a block's scores, its shape statistics beside them, the k best blocks of each group."""
    wide = shapes.groupBy(*keys, block).pivot("statistic", ["mean_value", "row_count"]).agg(F.first("value"))
    own = scores.groupBy(*keys, block).agg(F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.count("*").alias("n_scores"))
    return top_per_group(own.join(wide, [*keys, block], "left"), keys, [F.desc("mean_score"), F.asc(block)], k)


def merge_partials(parts: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Union of parts, the row of the first part that has a key kept."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        every = p if every is None else every.unionByName(p)
    return every.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_part", order))).where("_r = 1").drop("_r", "_part")


def pending(tasks: DataFrame, done: DataFrame, running: DataFrame, keys: list[str], stale_s: float = 3600) -> DataFrame:
    """Tasks neither done nor running; a running mark older than stale_s doesn't count."""
    busy = done.select(*keys).unionByName(running.where(F.col("age_s") <= stale_s).select(*keys))
    return tasks.join(busy.distinct(), keys, "left_anti")


def majority_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows with the most frequent value (the smallest of equally frequent ones)."""
    best = df.groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), column).limit(1).select(column)
    return df.join(F.broadcast(best), column, "left_semi")


def adjacent(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with the next one's value in its group."""
    return df.withColumn("next_value", F.lead(value).over(Window.partitionBy(*keys).orderBy(*order))).where("next_value is not null")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def cross_modal(scores: DataFrame, keys: list[str], modality: str, value: str) -> DataFrame:
    """Pairs of modalities of the same model: keys, modality_a < modality_b and the two values."""
    side = lambda x: scores.select(*keys, F.col(modality).alias(f"{modality}_{x}"), F.col(value).alias(f"{value}_{x}"))
    return side("a").join(side("b"), keys).where(F.col(f"{modality}_a") < F.col(f"{modality}_b"))


def score_correlation(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Means of x and y for each key (nulls and NaN left out), then their Pearson and Spearman correlation over the keys."""
    from ..functions.arrays import finite

    means = df.groupBy(key).agg(F.avg(finite(F.col(x).cast("double"))).alias("x"), F.avg(finite(F.col(y).cast("double"))).alias("y")).where("x is not null and y is not null")
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2  # noqa: E731  a row for each key
    return means.select("x", "y", rank("x").alias("rx"), rank("y").alias("ry")).agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))


def mean_matrix(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Elementwise mean of equally long vectors: keys, pos (0-based), mean."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("mean"))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


def with_counts(tasks: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct tasks with the number of blocks that each has (none: left out)."""
    return tasks.select(*keys).distinct().join(blocks.groupBy(*keys).agg(F.count("*").alias("n_blocks")), keys)


def in_order(df: DataFrame, column: str, order: list) -> DataFrame:
    """Rows whose value is in a list, sorted as the list has them."""
    places = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], [column, "_place"])
    return df.join(F.broadcast(places), column).orderBy("_place").drop("_place")


def truncated_pair(a: DataFrame, b: DataFrame, order_a: str, order_b: str, most_apart: float = 0.2) -> DataFrame:
    """Rows of two tables side by side by their places, as many as the shorter has; an error if the sizes differ by over most_apart of the longer."""
    from .metrics import numbered

    n, m = a.count(), b.count()
    if abs(n - m) > most_apart * max(n, m, 1):
        raise ValueError(f"{n} and {m} rows are too far apart")
    side = lambda df, order, x: numbered(df, order).select("_pos", F.struct(*df.columns).alias(x))
    return side(a, order_a, "a").join(side(b, order_b, "b"), "_pos")


def subsample(df: DataFrame, row_id: str, n: int, seed: int, legacy: bool = False) -> DataFrame:
    """n rows without replacement (all if there are fewer), by row places from a seeded numpy generator, the legacy one if asked."""
    import numpy as np

    from .metrics import numbered

    total = df.count()
    if total <= n:
        return df
    chosen = np.random.RandomState(seed).choice(total, n, replace=False) if legacy else np.sort(np.random.default_rng(seed).choice(total, n, replace=False))
    places = df.sparkSession.createDataFrame([(int(p),) for p in chosen], "_pos long")
    return numbered(df, row_id).join(places, "_pos", "left_semi").drop("_pos")


def random_pairs(df: DataFrame, row_id: str, seed: int, most: int = 50_000) -> DataFrame:
    """(i, j): up to `most` or 20 n random pairs of different rows."""
    import numpy as np

    from .metrics import numbered

    rows = numbered(df.select(row_id), row_id)
    n = rows.count()
    rng = np.random.default_rng(seed)
    pairs = rng.integers(0, max(n, 1), (min(most, 20 * n), 2))
    places = df.sparkSession.createDataFrame([(int(a), int(b)) for a, b in pairs[pairs[:, 0] != pairs[:, 1]]], "_a long, _b long")
    side = lambda x, out: rows.select(F.col("_pos").alias(x), F.col(row_id).alias(out))
    return places.join(side("_a", "i"), "_a").join(side("_b", "j"), "_b").select("i", "j")
