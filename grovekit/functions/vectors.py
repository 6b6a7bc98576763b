"""Element-wise functions of numeric arrays, inside whole-stage code or as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, v: s + v))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def scale(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(factor))


def ndarray(shape: list[int], strides: list[int], data: Column) -> Column:
    """A dense array of any rank: shape, strides in elements, data."""
    return F.struct(F.array(*map(F.lit, shape)).alias("shape"), F.array(*map(F.lit, strides)).alias("strides"), data.alias("data"))


def ndarray_item(array: Column, *position: int) -> Column:
    offset = sum((F.get(array["strides"], F.lit(k)) * F.lit(p) for k, p in enumerate(position)), F.lit(0))
    return F.get(array["data"], offset)
