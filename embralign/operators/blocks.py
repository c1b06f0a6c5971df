"""Every row against all rows, in blocks: the right side broadcast if it is small, a grid of tasks if not."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import matrix

#: The right side is broadcast up to this many bytes.
BROADCAST_BYTES = 64 << 20
LEFT_ROWS = 512

Partial = Callable[[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]], pd.DataFrame]


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, as one batch for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a and held and held[-1].column(key)[0].as_py() != k[a]:
                yield pa.concat_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def against_all(df: DataFrame, row_id: str, vectors: list[str], partial: Partial, schema: str, *, broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = 4096, left_rows: int = LEFT_ROWS) -> DataFrame:
    """partial(left ids, left matrices, right ids, right matrices) -> rows; callers combine the rows of a left id.

    The work is quadratic, as the result asks; memory is a block by a block. row_id must be unique.
    """
    rows = df.select(F.col(row_id).cast("long").alias("i"), *[F.col(v).cast("array<double>").alias(f"v{k}") for k, v in enumerate(vectors)])
    rows = rows.where(" and ".join(f"v{k} is not null" for k in range(len(vectors))))
    first = rows.first()
    if first is None:
        return df.sparkSession.createDataFrame([], schema)
    n, width = rows.count(), sum(len(first[f"v{k}"]) for k in range(len(vectors)))
    names = [f"v{k}" for k in range(len(vectors))]

    def pieces(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        return batch.column("i").to_numpy(), [matrix(batch.column(v)) for v in names]

    if n * (8 * width + 8) <= broadcast_bytes:
        got = pa.Table.from_batches(rows.toArrow().to_batches()) if n else None
        right = pieces(got.sort_by("i").combine_chunks().to_batches(max_chunksize=n)[0])
        shared = df.sparkSession.sparkContext.broadcast(right)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, mats = shared.value
            for whole in batches:
                for a in range(0, whole.num_rows, left_rows):
                    out = partial(*pieces(whole.slice(a, left_rows)), ids, mats)
                    if len(out):
                        yield pa.RecordBatch.from_pandas(out, preserve_index=False)

        many = rows.repartition(min(int(df.sparkSession.sparkContext.defaultParallelism), max(1, n // 64)))
        return many.mapInArrow(run, schema)

    blocks = -(-n // block_rows)
    block = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.withColumn("a", block).withColumn("b", every).withColumn("side", F.lit(0))
    right = rows.withColumn("b", block).withColumn("a", every).withColumn("side", F.lit(1))

    def grid(group: pa.Table) -> pa.Table:
        group = group.sort_by("i").combine_chunks()
        parts = []
        for side in (0, 1):
            t = group.filter(pa.compute.equal(group.column("side"), side)).combine_chunks()
            parts.append((t.column("i").to_numpy(), [matrix(t.column(v)) for v in names]))
        (li, lm), (ri, rm) = parts
        out = [partial(li[s : s + left_rows], [m[s : s + left_rows] for m in lm], ri, rm) for s in range(0, len(li), left_rows)] if len(ri) else []
        out = [x for x in out if len(x)]
        target = pa.schema([(f.name, kinds[f.dataType.typeName()]) for f in shape.fields])
        return pa.Table.from_pandas(pd.concat(out), preserve_index=False).cast(target) if out else target.empty_table()

    import pyarrow.compute  # noqa: F401  (used in the tasks)
    from pyspark.sql.types import _parse_datatype_string

    kinds = {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    shape = _parse_datatype_string(schema)
    return left.unionByName(right).groupBy("a", "b").applyInArrow(grid, schema)


class PairBlocks:
    """Each unordered pair of rows once, in small blocks; what a task makes of all its blocks leaves it, no row of a pair does.

    run(blocks) gets (left matrices, right matrices, same) of its task and yields record batches; where same is set both
    sides are the same rows, of which only pairs above the diagonal count. prepare is applied to the matrices of many rows at once.
    """

    LEFT, RIGHT = 128, 1024

    def __init__(self, df: DataFrame, row_id: str, vectors: list[str], prepare: Callable = list, *, broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = 4096):
        spark = df.sparkSession
        names = [f"v{k}" for k in range(len(vectors))]
        rows = df.select(F.col(row_id).cast("long").alias("i"), *[F.col(v).cast("array<double>").alias(n) for n, v in zip(names, vectors, strict=True)])
        self.rows, self.names, self.prepare = rows.where(" and ".join(f"{n} is not null" for n in names)), names, prepare
        self.n, first = self.rows.count(), self.rows.first()
        self.blocks, self.shared = -(-self.n // block_rows), None
        self.tasks = min(int(spark.sparkContext.defaultParallelism), max(1, self.n // self.LEFT))
        if first is not None and self.n * (8 * sum(len(first[v]) for v in names) + 8) <= broadcast_bytes:
            got = self.rows.toArrow().sort_by("i").combine_chunks()
            self.shared = spark.sparkContext.broadcast([matrix(got.column(v)) for v in names])

    def run(self, run: Callable, schema: str) -> DataFrame:
        spark, shared, names, prepare, tasks, blocks, left, right = self.rows.sparkSession, self.shared, self.names, self.prepare, self.tasks, self.blocks, self.LEFT, self.RIGHT
        cut = lambda mats, a, b: [m[a:b] for m in mats]

        def against(x, y, same):
            n, m = len(x[0]), len(y[0])
            for a in range(0, n, left):
                if same:
                    yield cut(x, a, a + left), cut(x, a, a + left), True
                for b in range(min(a + left, n) if same else 0, m, right):
                    yield cut(x, a, a + left), cut(y, b, b + right), False

        def strips(batches):
            mats = prepare(shared.value)
            n = len(mats[0])
            for batch in batches:
                for task in batch.column("id").to_pylist():
                    for a in range(task * left, n, tasks * left):  # dealt in turn: early rows meet more rows
                        yield cut(mats, a, a + left), cut(mats, a, a + left), True
                        for b in range(a + left, n, right):
                            yield cut(mats, a, a + left), cut(mats, b, b + right), False

        def cells(batches):
            for group in runs_of(batches, "cell"):
                second = group.column("second").to_numpy(zero_copy_only=False)
                x, y = (prepare([matrix(t.column(v)) for v in names]) for t in (group.filter(pa.array(~second)), group.filter(pa.array(second))))
                if group.column("same")[0].as_py():
                    yield from against(x, x, True)
                elif len(x[0]) and len(y[0]):
                    yield from against(x, y, False)

        if shared is not None:
            return spark.range(0, tasks, 1, tasks).mapInArrow(lambda batches: run(strips(batches)), schema)
        own = F.pmod(F.xxhash64("i"), F.lit(max(1, blocks)))
        each = self.rows.withColumn("a", own).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, blocks) - 1).cast("long"))))
        each = each.select((F.least("a", "b") * blocks + F.greatest("a", "b")).alias("cell"), (F.col("a") > F.col("b")).alias("second"), (F.col("a") == F.col("b")).alias("same"), *names)
        return each.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(lambda batches: run(cells(batches)), schema)
