"""Embedding tables: column names carry model, size and mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_column(name: str) -> tuple[str, str, str]:
    """model_size_mode; a model's name may itself hold underscores."""
    parts = name.rsplit("_", 2)
    if len(parts) < 3:
        raise ValueError(f"{name} isn't model_size_mode")
    return parts[0], parts[1], parts[2]


def vector_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]


def available_sizes(df: DataFrame) -> list[str]:
    return sorted({parse_column(c)[1] for c in vector_columns(df)})


def load_pair(spark: SparkSession, path: str, row_id: str, size: str | None = None) -> DataFrame:
    """(row_id, z1, z2) of the two modes of a size; an error unless there are exactly two."""
    df = spark.read.parquet(path)
    size = size or available_sizes(df)[0]
    found = [c for c in vector_columns(df) if parse_column(c)[1] == size]
    if len(found) != 2:
        raise ValueError(f"{len(found)} modes of size {size}, not two")
    return df.select(F.col(row_id).alias("row_id"), F.col(found[0]).alias("z1"), F.col(found[1]).alias("z2"))


def load_single(spark: SparkSession, path: str, row_id: str, size: str | None = None, mode: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    size = size or available_sizes(df)[0]
    found = [c for c in vector_columns(df) if parse_column(c)[1] == size and mode in (None, parse_column(c)[2])]
    if not found:
        raise ValueError(f"no column of size {size} and mode {mode}")
    return df.select(F.col(row_id).alias("row_id"), F.col(found[0]).alias("z"))


def blocks(spark: SparkSession, path: str, most_width: int = 16_384, without: tuple[str, ...] = ("lm_head",)) -> tuple[list[tuple[str, int]], int]:
    """Vector columns of a table with their widths, heads and over-wide ones left out, and its rows, from schema, footers and one row."""
    df = spark.read.parquet(path)
    names = [c for c in vector_columns(df) if not any(w in c for w in without)]
    one = df.select(*[F.size(c).alias(c) for c in names]).first() if names else None
    return [(c, one[c]) for c in names if one is not None and 0 < one[c] <= most_width], df.count()


def validate_inputs(df: DataFrame, z1: str, z2: str, same_width: bool = False) -> int:
    """The number of rows of a pair; an error if vectors are null, empty, non-finite or of changing (or, if asked, different) widths, or if there are fewer than two rows."""
    e1, e2 = (F.col(c).cast("array<double>") for c in (z1, z2))
    bad = lambda e: F.coalesce((F.size(e) < 1) | F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    r = df.agg(F.count("*").alias("n"), F.count_if(bad(e1) | bad(e2)).alias("bad"), *[f(F.size(e)).alias(f"{f.__name__}{k}") for k, e in ((1, e1), (2, e2)) for f in (F.min, F.max)]).first()
    if r.n < 2:
        raise ValueError("at least two rows are needed")
    if r.bad:
        raise ValueError(f"{r.bad} rows have a null, empty or non-finite vector")
    if r.min1 != r.max1 or r.min2 != r.max2 or same_width and r.min1 != r.min2:
        raise ValueError(f"widths {r.min1} to {r.max1} and {r.min2} to {r.max2}")
    return r.n


def compare_from_parquet(spark: SparkSession, path: str, row_id: str, metrics: list[str] | None = None, size: str | None = None, **params) -> DataFrame:
    """(size, metric, value, error) of the pair of a size (the first if none is named, each with size `all`)."""
    from ..operators.metrics import compare

    sizes = available_sizes(spark.read.parquet(path)) if size == "all" else [size or available_sizes(spark.read.parquet(path))[0]]
    out = None
    for x in sizes:
        pair = load_pair(spark, path, row_id, x)
        validate_inputs(pair, "z1", "z2")
        got = compare(pair, "row_id", "z1", "z2", metrics, **params).select(F.lit(x).alias("size"), "metric", "value", "error")
        out = got if out is None else out.unionByName(got)
    return out


def compare_models(spark: SparkSession, path: str, row_id: str, metrics: list[str] | None = None, **params) -> DataFrame:
    return compare_from_parquet(spark, path, row_id, metrics, "all", **params)


def append_text(df: DataFrame, path: str) -> None:
    """Rows of a one-column table of strings as further lines of a text table."""
    df.write.mode("append").text(path)


def read_percentiles(spark: SparkSession, path: str) -> DataFrame:
    """(survey, band, low, high) from JSON lines with those fields."""
    return spark.read.schema("survey string, band string, low double, high double").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv_union(tables: list[DataFrame], path: str) -> None:
    """Tables of different columns as one CSV table, missing cells empty."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(path)
