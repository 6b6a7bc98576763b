"""K-means by Lloyd's iterations: one aggregation by cluster each; the k centroids stand in the plan as literals."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Centroids = list[list[float]]


#: Up to so many terms (centroids times dims) distances are plain arithmetic, which Spark compiles; beyond, matrix rows.
PLAIN_TERMS = 64


def _closest(x: Column, centroids: Centroids) -> Column:
    """struct of the least squared distance d and its centroid k, the first of equals; null features give null."""
    if len(centroids) * len(centroids[0]) <= PLAIN_TERMS:
        def distance(c):
            out = F.lit(0.0)
            for j, v in enumerate(c):
                out = out + (F.get(x, F.lit(j)) - v) * (F.get(x, F.lit(j)) - v)
            return out

        best = F.array_min(F.array(*(F.struct(distance(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centroids))))
        return F.when(x.isNotNull(), best)
    flat = np.array(centroids, float)

    @F.pandas_udf("struct<d double, k int>")
    def closest(rows: pd.Series) -> pd.DataFrame:
        known = rows.notna().to_numpy()
        out = pd.DataFrame({"d": np.full(len(rows), np.nan), "k": pd.array([None] * len(rows), "Int32")})
        if known.any():
            m = np.stack(rows[known].to_numpy()).astype(float)
            d = np.stack([((m - c) ** 2).sum(1) for c in flat], 1)
            out.loc[known, "d"], out.loc[known, "k"] = d.min(1), d.argmin(1)
        return out

    return F.when(x.isNotNull(), closest(x))


def nearest(features: str | Column, centroids: Centroids) -> Column:
    """The cluster of least squared distance, the first of equals. Null features give null."""
    return _closest(F.col(features) if isinstance(features, str) else features, centroids)["k"]


def accumulate(assigned: DataFrame, dims: int, features: str = "features", cluster: str = "cluster") -> DataFrame:
    """cluster, n, sums: combined before the shuffle, a row a cluster after it."""
    sums = F.array(*(F.sum(F.get(features, F.lit(j)).cast("double")) for j in range(dims)))
    return assigned.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"), sums.alias("sums"))


def estimate(statistics: DataFrame, k: int, dims: int, cluster: str = "cluster") -> DataFrame:
    """cluster, centroid for all k clusters; an empty one has the zero vector."""
    every = statistics.sparkSession.range(k).select(F.col("id").cast("int").alias(cluster))
    mean = F.transform("sums", lambda s: s / F.col("n"))
    return every.join(statistics, cluster, "left").select(cluster, F.coalesce(mean, F.array_repeat(F.lit(0.0), dims)).alias("centroid"))


@dataclass(frozen=True)
class ConvergenceCriteria:
    """Stop after a number of updates or once centroids move by no more than a sum of distances; NaN never stops."""

    iterations: int | None = None
    change: float | None = None

    def limit_iterations(self, n: int) -> ConvergenceCriteria:
        return ConvergenceCriteria(n, self.change)

    def centroid_change(self, d: float) -> ConvergenceCriteria:
        return ConvergenceCriteria(self.iterations, d)

    def converges(self, old: Centroids, new: Centroids, iteration: int) -> bool:
        if self.iterations is not None and self.iterations <= iteration:
            return True
        if self.change is None:
            return False
        return sum(math.dist(a, b) for a, b in zip(old, new, strict=True)) <= self.change


def _digest(row_id: str, *salt: int) -> Column:
    """Hex digits that are the same on any partitioning and in any engine."""
    return F.md5(F.concat_ws(":", F.col(row_id).cast("string"), *(F.lit(str(s)) for s in salt)))


@dataclass(frozen=True)
class RandomSample:
    """k distinct rows in the order of a seeded hash of their id: the same on any partitioning."""

    seed: int = 0

    def select(self, df: DataFrame, k: int, features: str, row_id: str) -> Centroids:
        rows = df.where(F.col(features).isNotNull()).orderBy(_digest(row_id, self.seed), row_id).limit(k).select(features).collect()
        if len(rows) < k:
            raise ValueError(f"{k} rows are needed")
        return [[float(v) for v in r[0]] for r in rows]


@dataclass(frozen=True)
class KMeansPlusPlus:
    """Each next centroid is drawn with probability in proportion to the squared distance from those before: the least of
    -ln(u) / d2 over rows, u from a seeded hash, is such a draw in one pass."""

    seed: int = 0

    def select(self, df: DataFrame, k: int, features: str, row_id: str) -> Centroids:
        rows = df.where(F.col(features).isNotNull()).select(F.col(row_id).alias("_id"), F.transform(features, lambda v: v.cast("double")).alias("_x")).persist()
        chosen: Centroids = []
        for j in range(k):
            u = (F.conv(F.substring(_digest("_id", self.seed, j), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / float(1 << 52)
            d2 = F.lit(1.0)
            if chosen:
                d2 = _closest(F.col("_x"), chosen)["d"]
            key = F.when(d2 > 0, -F.log(u) / d2).otherwise(F.lit(float("inf")))
            r = rows.agg(F.min_by("_x", F.struct(key, "_id")).alias("x")).first()
            if r["x"] is None:
                raise ValueError("rows are needed")
            chosen.append(list(r["x"]))
        rows.unpersist()
        return chosen


@dataclass
class KMeansModel:
    centroids: Centroids
    iterations: int

    def transform(self, df: DataFrame, features: str = "features", name: str = "cluster") -> DataFrame:
        return df.withColumn(name, nearest(features, self.centroids))


@dataclass
class KMeans:
    n_clusters: int
    dims: int
    criteria: ConvergenceCriteria
    init: RandomSample | KMeansPlusPlus = RandomSample()

    def fit(self, df: DataFrame, features: str = "features", row_id: str = "row_id", initial: Centroids | None = None) -> KMeansModel:
        if self.n_clusters < 1 or self.criteria.iterations == 0:
            raise ValueError("a cluster and an iteration are needed")
        points = df.select(F.transform(features, lambda v: v.cast("double")).alias("features")).where("features is not null").persist()
        old = initial or self.init.select(df, self.n_clusters, features, row_id)
        iteration = 0
        while True:
            assigned = points.withColumn("cluster", nearest("features", old))
            rows = {r["cluster"]: r for r in accumulate(assigned, self.dims).collect()}  # k rows
            new = [[s / rows[k]["n"] for s in rows[k]["sums"]] if k in rows else [0.0] * self.dims for k in range(self.n_clusters)]
            iteration += 1
            if self.criteria.converges(old, new, iteration):
                points.unpersist()
                return KMeansModel(new, iteration)
            old = new
