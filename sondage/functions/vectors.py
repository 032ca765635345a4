"""Column functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """v at length 1; a zero vector is left as it is."""
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))), 1)


def truncated(v: Column, dimensions: int) -> Column:
    """The first dimensions of v, at length 1."""
    return normalise(F.slice(v, 1, dimensions))


def quantise(v: Column) -> Column:
    """struct(q, scale, offset): 8-bit steps between the least and the greatest component."""
    low, high = F.array_min(v), F.array_max(v)
    q = F.transform(v, lambda x: F.when(high == low, F.lit(0)).otherwise(F.round((x - low) / (high - low) * 255).cast("int")))
    return F.struct(q.alias("q"), (high - low).alias("scale"), low.alias("offset"))


def dequantise(code: Column) -> Column:
    return F.transform(code["q"], lambda q: q / F.lit(255.0) * code["scale"] + code["offset"])


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
