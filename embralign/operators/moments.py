"""Joint first and second moments of two vector columns, in one pass, optionally by key."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a tile of a partial; wider partials are added on executors, tile by tile.
TILE = 1 << 16
#: Stands for a null key on the way.
NULL = "\0null\1"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long rows as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and len(flat) % n:
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1) if n else np.empty((0, 0))


@dataclass
class Moments:
    """n, sums and Gram matrices of rows minus a shift (which keeps large means from cancelling)."""

    n: int
    shift1: np.ndarray
    shift2: np.ndarray
    s1: np.ndarray
    s2: np.ndarray
    g11: np.ndarray
    g22: np.ndarray
    g12: np.ndarray

    def __add__(self, o: Moments) -> Moments:
        return Moments(self.n + o.n, self.shift1, self.shift2, *(getattr(self, k) + getattr(o, k) for k in ("s1", "s2", "g11", "g22", "g12")))

    def __sub__(self, o: Moments) -> Moments:
        return Moments(self.n - o.n, self.shift1, self.shift2, *(getattr(self, k) - getattr(o, k) for k in ("s1", "s2", "g11", "g22", "g12")))

    @property
    def mean1(self) -> np.ndarray:
        return self.shift1 + self.s1 / self.n

    @property
    def mean2(self) -> np.ndarray:
        return self.shift2 + self.s2 / self.n

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.n
        return self.g11 - np.outer(self.s1, self.s1) / n, self.g22 - np.outer(self.s2, self.s2) / n, self.g12 - np.outer(self.s1, self.s2) / n

    def raw(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Uncentred: sum 1, sum 2, Gram 1, Gram 2, cross Gram."""
        c11, c22, c12 = self.centred()
        m1, m2, n = self.mean1, self.mean2, self.n
        return n * m1, n * m2, c11 + n * np.outer(m1, m1), c22 + n * np.outer(m2, m2), c12 + n * np.outer(m1, m2)


def moments_by_key(df: DataFrame, z1: str, z2: str, key: str | None = None, shift: tuple[np.ndarray, np.ndarray] | None = None) -> dict:
    """Moments of (z1, z2) for each value of key (None: one entry, key None). Rows with a null vector don't count.

    Moments that are to be added or subtracted need one shift; without one given, it is some row.
    Each task sends one partial per key it has, cut into tiles; the keys must be few (folds, properties, models).
    """
    rows = df.select(F.lit(None).cast("string").alias("k") if key is None else F.col(key).cast("string").alias("k"), F.col(z1).cast("array<double>").alias("z1"), F.col(z2).cast("array<double>").alias("z2")).where("z1 is not null and z2 is not null")
    head = rows.first()
    if head is None:
        return {}
    shift1, shift2 = shift or (np.array(head.z1), np.array(head.z2))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            a, b = matrix(batch.column("z1")) - shift1, matrix(batch.column("z2")) - shift2
            keys = np.array(batch.column("k").fill_null(NULL).to_pylist(), object)
            names, code = (keys[:1], np.zeros(len(keys), int)) if key is None else np.unique(keys.astype(str), return_inverse=True)
            for c, k in enumerate(names.tolist()):
                own = slice(None) if len(names) == 1 else code == c
                x, y = a[own], b[own]
                part = [len(x), x.sum(0), y.sum(0), x.T @ x, y.T @ y, x.T @ y]
                sums[k] = [p + q for p, q in zip(sums[k], part, strict=True)] if k in sums else part
        for k, part in sums.items():
            flat = np.concatenate([np.ravel(p) for p in part]).astype(np.float64)
            for t in range(0, len(flat), TILE):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t], pa.int64()), pa.array([flat[t : t + TILE].tobytes()], pa.binary())], names=["k", "tile", "m"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            for k, t, m in zip(*(batch.column(c) for c in ("k", "tile", "m")), strict=True):
                own, x = (k.as_py(), t.as_py()), np.frombuffer(m.as_buffer())
                if held is not None and own != last:
                    yield tile(*last, held)
                    held = None
                held, last = x.copy() if held is None else held + x, own
        if held is not None:
            yield tile(*last, held)

    def tile(k: str, t: int, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t], pa.int64()), pa.array([m.tobytes()], pa.binary())], names=["k", "tile", "m"])

    d1, d2 = len(shift1), len(shift2)
    kind = "k string, tile long, m binary"
    parts = rows.mapInArrow(partial, kind)
    width = 1 + d1 + d2 + d1 * d1 + d2 * d2 + d1 * d2
    if width > TILE:  # else a task's partial is one small row, and the driver adds them
        parts = parts.repartition("k", "tile").sortWithinPartitions("k", "tile").mapInArrow(added, kind)
    total: dict = {}
    for row in parts.toLocalIterator():
        m = total.setdefault(row.k, np.zeros(width))
        x = np.frombuffer(row.m)
        m[row.tile : row.tile + len(x)] += x
    out: dict = {}
    for k, m in total.items():
        n, s1, s2, g11, g22, g12 = np.split(m, np.cumsum([1, d1, d2, d1 * d1, d2 * d2]))
        out[None if k == NULL else k] = Moments(int(n[0]), shift1, shift2, s1, s2, g11.reshape(d1, d1), g22.reshape(d2, d2), g12.reshape(d1, d2))
    return out


def paired_moments(df: DataFrame, z1: str = "z1", z2: str = "z2") -> Moments:
    found = moments_by_key(df, z1, z2)
    if not found:
        raise ValueError("no rows")
    return found[None]
