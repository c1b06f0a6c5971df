"""Square images of a centred object: foreground by blur and threshold, the blob at the centre, a crop around it, resized.

All work is inside one image, so rows stay where they are and go through Arrow in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The blur's taps and sigma, the histogram's bins, the margin and the size of the result.
TAPS, SIGMA, BINS, PADDING, SIZE = 41, 10.0, 256, 0.1, 96


def blur(image: np.ndarray, taps: int = TAPS, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian blur along both axes; beyond the border the image is mirrored without repeating the edge."""
    half = taps // 2
    weight = np.exp(-((np.arange(taps) - half) ** 2) / (2 * sigma * sigma))
    weight /= weight.sum()
    for axis in (0, 1):
        n = image.shape[axis]
        place = np.arange(-half, n + half)
        period = max(1, 2 * (n - 1))
        place = np.abs((place + (n - 1)) % period - (n - 1)) if n > 1 else place * 0
        wide = np.take(image, place, axis=axis)
        image = np.apply_along_axis(lambda row: np.convolve(row, weight, "valid"), axis, wide)
    return image


def otsu(values: np.ndarray, bins: int = BINS) -> float:
    """The centre of the histogram bin that best separates two classes: the largest variance between them."""
    if values.min() == values.max():
        return float(values.min())
    counts, edges = np.histogram(values, bins)
    centre = (edges[:-1] + edges[1:]) / 2
    below, total = np.cumsum(counts)[:-1], counts.sum()
    sums = np.cumsum(counts * centre)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * (total - below) * (sums[:-1] / below - (sums[-1] - sums[:-1]) / (total - below)) ** 2
    return float(centre[np.nanargmax(between)])


def centre_blob(mask: np.ndarray) -> tuple[int, tuple[int, int, int, int] | None]:
    """Pixels of the connected foreground (corners touch) at the centre, and its first and last row and column."""
    h, w = mask.shape
    seen = np.zeros((h + 2, w + 2), bool)
    seen[h // 2 + 1, w // 2 + 1] = mask[h // 2, w // 2]
    size = 0
    while (now := int(seen.sum())) != size:
        size = now
        grown = seen.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                grown[1:-1, 1:-1] |= seen[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx]
        seen[1:-1, 1:-1] = grown[1:-1, 1:-1] & mask
    if not size:
        return 0, None
    rows, columns = np.nonzero(seen[1:-1, 1:-1])
    return size, (int(rows.min()), int(rows.max()), int(columns.min()), int(columns.max()))


def resized(image: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear zoom with corners on corners."""
    for axis in (0, 1):
        n = image.shape[axis]
        m = max(1, round(n * factor))
        at = np.arange(m) * ((n - 1) / (m - 1) if m > 1 else 0.0)
        low = np.minimum(at.astype(int), n - 1)
        high = np.minimum(low + 1, n - 1)
        share = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        image = np.take(image, low, axis) * (1 - share) + np.take(image, high, axis) * share
    return image


def fitted(image: np.ndarray, padding: float = PADDING, size: int = SIZE, extent: tuple[int, int, int, int] | None = None) -> tuple[int, np.ndarray]:
    """Blob size and the image cropped about its centre to the blob (or a given extent) with a margin, resized; without a blob the middle, as it is."""
    h, w = image.shape
    blob = 0
    if extent is None:
        smooth = blur(image)
        blob, extent = centre_blob(smooth > otsu(smooth))
    if extent is not None:
        length = max(extent[1] - extent[0], extent[3] - extent[2]) + 1
        half = (length + 2 * int(length * padding)) // 2
        crop = image[max(0, h // 2 - half) : h // 2 + half, max(0, w // 2 - half) : w // 2 + half]
        if min(crop.shape):
            return blob, resized(crop, size / max(crop.shape))
    return blob, image[max(0, h // 2 - size // 2) : h // 2 + size // 2, max(0, w // 2 - size // 2) : w // 2 + size // 2]


def fit_images(df: DataFrame, row_id: str, image: str, *, padding: float = PADDING, size: int = SIZE, extent: tuple[int, int, int, int] | None = None) -> DataFrame:
    """df (row_id, image array<array<double>>, ...) -> row_id, blob_size, fitted. Null and empty images give nulls."""
    rows = df.select(row_id, image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fitted(np.array(x, float), padding, size, extent) if x and x[0] else (None, None) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in out], pa.int64()), pa.array([None if y is None else y.tolist() for _, y in out], pa.list_(pa.list_(pa.float64())))], names=[row_id, "blob_size", "fitted"])

    return rows.mapInArrow(run, T.StructType([rows.schema.fields[0], T.StructField("blob_size", T.LongType()), T.StructField("fitted", T.ArrayType(T.ArrayType(T.DoubleType())))]))
