"""Random training data. Values come from a hash of (row, dimension, seed), so they don't depend on the partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(row: Column, stream: int, seed: int) -> Column:
    """Uniform in (0, 1)."""
    bits = F.xxhash64(row, F.lit(stream), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))
    return (bits + 0.5) / float(1 << 53)


@dataclass(frozen=True)
class NormalParams:
    mean: float
    sd: float

    def draw(self, row: Column, stream: int, seed: int) -> Column:
        u, v = unit(row, 2 * stream, seed), unit(row, 2 * stream + 1, seed)
        return self.mean + self.sd * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


@dataclass(frozen=True)
class UniformParams:
    """Half-open."""

    low: float
    high: float

    def draw(self, row: Column, stream: int, seed: int) -> Column:
        return self.low + (self.high - self.low) * unit(row, 2 * stream, seed)


@dataclass(frozen=True)
class Constant:
    value: float

    def draw(self, row: Column, stream: int, seed: int) -> Column:
        return F.lit(self.value)


@dataclass(frozen=True)
class _Sizes:
    samples: int = 100
    chunks: int = 1
    rounds: int = 1
    seed: int = 0

    def rows(self, spark: SparkSession) -> DataFrame:
        """A row for each sample: row, epoch (of rounds), chunk (of chunks a round)."""
        per_round = self.samples * self.chunks
        row = F.col("id")
        return spark.range(per_round * self.rounds).select(
            row.alias("row"), F.floor(row / per_round).alias("epoch"), F.floor(F.pmod(row, F.lit(per_round)) / self.samples).alias("chunk")
        )


@dataclass(frozen=True)
class RandomClassification(_Sizes):
    """Each sample draws a cluster, then its features and its target from the cluster's distributions."""

    x_distributions: list[list] = field(default_factory=list)
    y_distributions: list = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        k, d = len(self.y_distributions), len(self.x_distributions[0])
        row = F.col("row")
        cluster = F.floor(unit(row, 1_000_001, self.seed) * k).cast("int")
        pick = lambda values: F.get(F.array(*(v.cast("double") for v in values)), F.col("cluster"))
        x = [pick([c[j].draw(row, 1 + j, self.seed) for c in self.x_distributions]) for j in range(d)]
        y = pick([c.draw(row, 500_000, self.seed) for c in self.y_distributions])
        return self.rows(spark).withColumn("cluster", cluster).select("row", "epoch", "chunk", *(c.alias(f"f{j}") for j, c in enumerate(x)), y.alias("y"))


@dataclass(frozen=True)
class RandomRegression(_Sizes):
    """mapper takes the drawn feature columns and gives the final features and the target."""

    x_distributions: list = field(default_factory=list)
    mapper: Callable[[list[Column]], tuple[list[Column], Column]] = lambda x: (x, sum(x[1:], x[0]))

    def frame(self, spark: SparkSession) -> DataFrame:
        row = F.col("row")
        drawn = self.rows(spark).select("*", *(d.draw(row, 1 + j, self.seed).cast("double").alias(f"_x{j}") for j, d in enumerate(self.x_distributions)))
        x, y = self.mapper([F.col(f"_x{j}") for j in range(len(self.x_distributions))])
        return drawn.select("row", "epoch", "chunk", *(c.alias(f"f{j}") for j, c in enumerate(x)), y.alias("y"))
