"""Bounded, deterministic samples of labelled rows, and the fold that is never learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 4, is 2 (null: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded(rows: DataFrame, label: str, key: str, per_label: int, most_labels: int = 1000) -> DataFrame:
    """About per_label rows of each label at most, those with the smallest hashes of key; never over twice as many together.

    Of more than most_labels labels the most frequent count (then the smallest): a column of labels that is full of slips stays bounded.
    """
    told = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(most_labels)
    counts = {r[label]: r["n"] for r in told.collect()}
    if not counts:
        return rows
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])
    draw = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    return rows.where(draw < F.element_at(share, F.col(label))).orderBy(F.xxhash64(key, F.lit("sample")), key).limit(2 * per_label * len(counts))
