"""Vector arithmetic on array columns, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, tiny: float = 1e-12) -> Column:
    """Cosine with rows of (nearly) zero norm left as they are, so that they give 0."""
    guard = lambda v: F.when(norm(v) < tiny, F.lit(1.0)).otherwise(norm(v))
    return dot(a, b) / (guard(a) * guard(b))


def clipped(a: Column, low: Column, high: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(F.least(x, high), low))


def sorted_gap(a: Column, b: Column) -> Column:
    """Mean distance of two equally long samples in sorted order (1-D Wasserstein)."""
    gaps = F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def digamma(n: Column) -> Column:
    """At a positive number: ten steps up, then the asymptotic series."""
    y = n + F.lit(10.0)
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    for i in range(10):
        series = series - 1 / (n + F.lit(float(i)))
    return series


def finite(c: Column) -> Column:
    """NaN and infinities become null, so that SQL aggregates skip them."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def arcsinh_stretch(x: Column, low: Column, high: Column, softening: float = 20.0) -> Column:
    """The share of [low, high] in [0, 1] on an inverse hyperbolic sine scale."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.asinh(softening * (x - low) / (high - low)) / F.asinh(F.lit(softening))))


def wasserstein(a: Column, b: Column) -> Column:
    """1-D Wasserstein distance of two samples of any sizes: the area between their distribution functions. Null if either has no finite value."""
    a, b = (F.filter(doubles(x), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) for x in (a, b))
    every = F.array_sort(F.concat(a, b))
    below = lambda x, v: F.size(F.filter(x, lambda u: u <= v)) / F.size(x)
    steps = F.transform(F.sequence(F.lit(1), F.size(every) - 1), lambda i: (F.element_at(every, i + 1) - F.element_at(every, i)) * F.abs(below(a, F.element_at(every, i)) - below(b, F.element_at(every, i))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(steps, F.lit(0.0), lambda t, x: t + x))


def percentile(a: Column, q: float) -> Column:
    """Linearly interpolated percentile (0 to 1) of the non-null values of an array."""
    a = F.array_sort(F.filter(doubles(a), lambda v: v.isNotNull() & ~F.isnan(v)))
    at = (F.size(a) - 1) * F.lit(float(q))
    low, high = F.element_at(a, F.floor(at).cast("int") + 1), F.element_at(a, F.ceil(at).cast("int") + 1)
    return F.when(F.size(a) > 0, low + (high - low) * (at - F.floor(at)))


def has_range(a: Column, low: float = 0.05, high: float = 0.99) -> Column:
    """Whether an image's values differ between two percentiles; a flat or empty one has no dynamic range."""
    return F.coalesce(percentile(a, low) != percentile(a, high), F.lit(False))


def pick(bands: Column, places: list[int]) -> Column:
    """The bands at 0-based places, in their order; a place that repeats replicates its band."""
    return F.array(*[F.element_at(bands, i + 1) for i in places])


def linear_stretch(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


def pool(tokens: Column, how: str = "mean") -> Column:
    """One vector of an array of token vectors: their mean, the first or the last."""
    if how == "first":
        return F.element_at(tokens, 1)
    if how == "last":
        return F.element_at(tokens, -1)
    if how != "mean":
        raise ValueError(f"unknown pooling {how}")
    zero = F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0))
    total = F.aggregate(tokens, zero, lambda t, v: F.zip_with(t, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(tokens))


def windows(values: Column, width: int, step: int) -> Column:
    """Runs of `width` values, a step apart; a rest shorter than width is left out."""
    starts = F.when(F.size(values) >= width, F.sequence(F.lit(1), F.size(values) - width + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(values, i, width))
