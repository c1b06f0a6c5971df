"""Packing of documents into sequences by cutting-stock column generation.

A document longer than a sequence is cut into full sequences and a rest, and a rest longer than
`largest` (half a sequence) is cut there: uncut, rests between a half and a whole leave 7 % padding on
the test corpus, cut 0.5 %. The rests are the items of a cutting-stock problem whose data are one histogram of lengths (at most max_len / quantum rows,
whatever the corpus). A linear program chooses how often to use each pattern, a multiset of lengths
that fits; patterns are priced in by a knapsack dynamic program over the dual values until none
improves or the bound says that the rest of the gap is below `gap`. Rounded-down patterns take nearly
all items, best-fit patterns the few that rounding leaves. Documents are ranked inside their length
(by distributed counts), and each rank has its place in a pattern.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import Scratch, read_table
from ._text import small_batches
from ._tokens import encoder, tokenizer_path


def price(value: np.ndarray, size: np.ndarray, capacity: int, most: int = 40) -> tuple[float, list[np.ndarray]]:
    """Unbounded knapsack by dynamic programming: the most value that fits, and the best patterns that begin with different items."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            total = best[c - size[:k]] + value[:k]
            j = int(total.argmax())
            if total[j] > best[c] + 1e-12:
                best[c], take[c] = total[j], j
    whole = value + best[capacity - size]
    patterns = []
    for first in np.argsort(-whole, kind="stable")[:most].tolist():
        counts, c = np.zeros(len(size), np.int64), capacity - int(size[first])
        counts[first] = 1
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                counts[take[c]] += 1
                c -= int(size[take[c]])
        patterns.append(counts)
    return float(best[capacity]), patterns


def inverted(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with partial pivoting, without a threaded library's start-up and locks."""
    n = len(a)
    t = np.hstack([a, np.eye(n)])
    for i in range(n):
        j = i + int(np.abs(t[i:, i]).argmax())
        t[[i, j]] = t[[j, i]]
        t[i] /= t[i, i]
        rest = t[:, i].copy()
        rest[i] = 0
        t -= np.outer(rest, t[i])
    return t[:, n:]


def solve(size: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.003, rounds: int = 600) -> list[tuple[int, np.ndarray]]:
    """Patterns (times used, count of each size) that together hold the demand of every size.

    size ascends. Column generation with a revised simplex: the basis starts with one pattern for each
    size (as many of it as fit), each knapsack prices in several columns, and the basis inverse is
    updated by each pivot and built anew now and then.
    """
    m = len(size)
    basis = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / (capacity // size))
    x = inverse @ demand
    pivots = 0
    for _ in range(rounds):
        worth, columns = price(np.maximum(inverse.sum(axis=0), 0), size, capacity)
        if worth <= 1 + gap:  # the objective divided by worth is a lower bound
            break
        for column in columns:
            if inverse.sum(axis=0) @ column <= 1 + gap / 2:
                continue
            step = inverse @ column
            ratio = np.full(m, np.inf)
            up = step > 1e-9
            ratio[up] = x[up] / step[up]
            row = int(ratio.argmin())
            if not np.isfinite(ratio[row]):
                continue
            basis[:, row] = column
            pivot = inverse[row] / step[row]
            inverse -= np.outer(step, pivot)
            inverse[row] = pivot
            x = np.maximum(x - ratio[row] * step, 0)
            x[row] = ratio[row]
            pivots += 1
            if pivots % 300 == 0:
                inverse = inverted(basis)
                x = np.maximum(inverse @ demand, 0)
    plan, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable").tolist():
        column = basis[:, j].round().astype(np.int64)
        used = column > 0
        times = min(int(np.floor(x[j] + 1e-9)), int((left[used] // column[used]).min()))
        if times > 0:
            plan.append((times, column))
            left -= times * column
    return plan + best_fit(size, left, capacity)


def best_fit(size: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Largest first, each time the largest that still fits; equal patterns are repeated at once."""
    plan, left = [], left.copy()
    while left.any():
        column, room = np.zeros(len(size), np.int64), capacity
        for i in np.argsort(-size, kind="stable").tolist():
            k = min(int(left[i]), room // int(size[i]))
            if k > 0:
                column[i] = k
                room -= k * int(size[i])
        used = column > 0
        times = int((left[used] // column[used]).min())
        plan.append((times, column))
        left -= times * column
    return plan


def places(plan: list[tuple[int, np.ndarray]], m: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size, where its ranks go: first rank, first sequence and count in a sequence of each pattern, and the order of the size in it."""
    out: list[list] = [[] for _ in range(m)]
    given, sequence = np.zeros(m, np.int64), 0
    for times, column in plan:
        for order, i in enumerate(np.flatnonzero(column).tolist()):
            out[i].append((int(given[i]), sequence, int(column[i]), order))
            given[i] += times * int(column[i])
        sequence += times
    return [tuple(np.array(x, np.int64).reshape(-1, 4).T) for x in out]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, max_len: int, largest: int, with_ids: bool = False) -> DataFrame:
    """Every document's ids, cut: doc_id, start, length, ids_crc32, doc_tokens (and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in small_batches(batches, "text"):
            ids, counts = enc.many(batch.column("text"))
            doc, start, length, crc, total, own, at = [], [], [], [], [], [], 0
            for doc_id, c in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                x = np.append(ids[at : at + c], np.uint32(end_id)).astype("<u4")
                at += c
                whole = (c + 1) // max_len * max_len
                for a, b in [*((i, i + max_len) for i in range(0, whole, max_len)), *((i, min(i + largest, c + 1)) for i in range(whole, c + 1, largest))]:
                    part = x[a:b]
                    doc.append(doc_id)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(c + 1)
                    if with_ids:
                        own.append(part.astype(np.int32))
            arrays = [pa.array(v, pa.int64()) for v in (doc, start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(own, pa.list_(pa.int32()))] if with_ids else []), names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 1, max_len: int = 2048, largest: int | None = None, quantum: int = 8, gap: float = 0.003, rows_per_bucket: int = 20_000, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Lengths are rounded up to a multiple of `quantum` for planning only; in a sequence the pieces stand
    close together from 0. Null and empty texts are the end id alone. Rows that repeat a doc_id are
    documents of their own. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    cut = pieces(docs, tokenizer, end_id, max_len, largest or max_len // 2, with_ids).withColumn("bin", F.least(F.ceil(F.col("length") / quantum) * quantum, F.lit(max_len)).cast("int"))
    cut = scratch.table(cut, "pieces")
    histogram = {r["bin"]: r["n"] for r in cut.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # max_len / quantum rows at most
    size = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in size.tolist()], np.int64)
    plan = solve(-(-size // quantum), demand, max_len // quantum, gap) if len(size) else []
    table = spark.sparkContext.broadcast({int(s): p for s, p in zip(size.tolist(), places(plan, len(size)), strict=True)})

    most = int(demand.max()) if len(size) else 1
    buckets = -(-most // rows_per_bucket)
    ranked = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    earlier = Window.partitionBy("bin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = ranked.groupBy("bin", "bucket").agg(F.count("*").alias("c")).select("bin", "bucket", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("bin", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = ranked.withColumn("place", F.row_number().over(inside) - 1).join(first, ["bin", "bucket"]).withColumn("rank", F.col("first") + F.col("place")).drop("bucket", "first", "place")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rank, bins = batch.column("rank").to_numpy(), batch.column("bin").to_numpy()
            sequence, order = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for b in np.unique(bins).tolist():
                rows = np.flatnonzero(bins == b)
                begin, base, count, at = table.value[b]
                k = np.searchsorted(begin, rank[rows], side="right") - 1
                beyond = rank[rows] - begin[k]
                sequence[rows] = base[k] + beyond // count[k]
                order[rows] = at[k]
            keep = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(order)], names=[*names, "sequence_id", "order"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, " + "ids array<int>, " * with_ids + "sequence_id long, order long"
    placed = ranked.select(*names, "rank", "bin").mapInArrow(assign, kinds)
    before = Window.partitionBy("sequence_id").orderBy("order", "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)  # max_len rows at most
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("order")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("word_bpe_49k.json"))
