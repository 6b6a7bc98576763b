"""Quantizers as column expressions over thresholds that the driver computes once."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(thresholds: list[float], holds) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), holds)).cast("bigint")


@dataclass(frozen=True)
class UniformQuantizer:
    """0 below low, 1..steps in equal steps of [low, high), steps + 1 from high on. Null and NaN give null."""

    low: float
    high: float
    steps: int

    def __post_init__(self):
        if self.steps < 1 or not self.low < self.high:
            raise ValueError("steps >= 1 and low < high are needed")

    @classmethod
    def from_distribution_params(cls, params, steps: int) -> UniformQuantizer:
        return cls(params.low, params.high, steps)

    def thresholds(self) -> list[float]:
        return [(s / self.steps) * (self.high - self.low) + self.low for s in range(self.steps + 1)]

    def quantize(self, value: Column | str) -> Column:
        v = _double(value)
        return F.when(v.isNull() | F.isnan(v), None).otherwise(_count(self.thresholds(), lambda t: t <= v))


@dataclass(frozen=True)
class NormalQuantizer:
    """Buckets 0..steps-1 of equal probability under a normal distribution; a boundary is in the bucket below it."""

    mean: float
    sd: float
    steps: int

    def __post_init__(self):
        if self.steps < 1 or self.sd <= 0:
            raise ValueError("steps >= 1 and sd > 0 are needed")

    @classmethod
    def from_distribution_params(cls, params, steps: int) -> NormalQuantizer:
        return cls(params.mean, params.sd, steps)

    def thresholds(self) -> list[float]:
        d = NormalDist(self.mean, self.sd)
        return [d.inv_cdf(s / self.steps) for s in range(1, self.steps)]

    def quantize(self, value: Column | str) -> Column:
        v = _double(value)
        if self.steps == 1:
            return F.when(v.isNull() | F.isnan(v), None).otherwise(F.lit(0).cast("bigint"))
        return F.when(v.isNull() | F.isnan(v), None).otherwise(_count(self.thresholds(), lambda t: t < v))


def _double(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")
