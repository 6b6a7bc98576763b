"""Mergeable histograms of feature values (centroids with masses) and of target values (intervals with counts and sums).

Exact histograms are plain grouped counts: deterministic, combined map-side, and the default while values are few.
Bounded ones use histogram_numeric for features and a grouped-aggregate pandas UDF for targets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package

# ---- plans ----------------------------------------------------------------------------------------------------------


def unpivot(df: DataFrame, features: list[str], keep: list[str], kind: str = "double") -> DataFrame:
    """keep, attr (number of the feature), value. Nulls and NaN are left out."""
    pairs = F.array(*(F.struct(F.lit(i).alias("attr"), F.col(c).cast(kind).alias("value")) for i, c in enumerate(features)))
    long = df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.attr", "_p.value").where("value is not null")
    return long.where(~F.isnan("value")) if kind == "double" else long


def feature_histogram_exact(df: DataFrame, features: list[str], label: str, node: str = "node_id") -> DataFrame:
    """node, attr, label, value, n."""
    return unpivot(df, features, [node, label]).groupBy(node, "attr", label, "value").agg(F.count("*").alias("n"))


def feature_histogram(df: DataFrame, features: list[str], label: str, bins: int, node: str = "node_id") -> DataFrame:
    """node, attr, label, bins: array of (x, y), bins entries at most."""
    if bins < 2:
        raise ValueError("bins >= 2 is needed")
    grouped = unpivot(df, features, [node, label]).groupBy(node, "attr", label)
    return grouped.agg(fuse_equal(F.histogram_numeric("value", F.lit(bins))).alias("bins"))


def fuse_equal(bins: Column) -> Column:
    """Bins of one position as one bin; a merge of partial results can leave several."""
    xs = F.array_sort(F.array_distinct(F.transform(bins, lambda b: b["x"])))
    mass = lambda x: F.aggregate(F.filter(bins, lambda b: b["x"] == x), F.lit(0.0), lambda s, b: s + b["y"])
    return F.transform(xs, lambda x: F.struct(x.alias("x"), mass(x).alias("y")))


def target_histogram_exact(df: DataFrame, features: list[str], target: str, node: str = "node_id", weight: str | None = None) -> DataFrame:
    """node, attr, value, y, n; weight: the column that tells how many rows a row stands for."""
    long = unpivot(df, features, [node, target, *([weight] if weight else [])], "bigint")
    return long.groupBy(node, "attr", "value", F.col(target).alias("y")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def target_histogram(exact: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """keys, bins: array of (left, right, count, sum), from distinct target values with counts (y, n).

    Targets are first reduced to 64 * bins centroids by partial aggregation, so that no group outgrows a task.
    """
    ship_package(exact.sparkSession)
    fine = exact.groupBy(*keys).agg(F.histogram_numeric(F.col("y").cast("double"), F.lit(64 * bins)).alias("_b"), F.count("*").alias("_n"))
    return fine.select(*keys, _interval_udf(bins)("_b").alias("bins"))


def _interval_udf(bins: int):
    @F.pandas_udf("array<struct<left:double,right:double,count:bigint,sum:double>>")
    def run(parts: pd.Series) -> pd.Series:
        def one(part):
            h = TargetHistogram(bins)
            for b in part:
                h.insert(float(b["x"]), round(b["y"]))
            return [{"left": x.left, "right": x.right, "count": x.count, "sum": x.sum} for x in h.bins]

        return parts.map(one)

    return run


def upper_median(y: str | Column) -> Column:
    """The element of rank floor(n / 2), from 0: of an even number the upper one. Null of no rows."""
    v = F.sort_array(F.collect_list(y))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def weighted_upper_median(values: DataFrame, keys: list[str], y: str = "y", n: str = "n") -> DataFrame:
    """keys, median: the same of (y, n) counts, by a running sum over distinct values."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    summed = values.groupBy(*keys, y).agg(F.sum(n).alias("_n"))
    ranked = summed.withColumn("_upto", F.sum("_n").over(w.orderBy(y))).withColumn("_total", F.sum("_n").over(w))
    return ranked.where(F.col("_upto") > F.floor(F.col("_total") / 2)).groupBy(*keys).agg(F.min(y).alias("median"))


# ---- bounded histograms on the driver: a split step sees a few bins of each node ------------------------------------


@dataclass
class FeatureHistogram:
    """Centroids and masses in order of position, limit entries at most."""

    limit: int
    points: list[tuple[float, float]]

    @classmethod
    def empty(cls, limit: int) -> FeatureHistogram:
        if limit < 1:
            raise ValueError("limit >= 1 is needed")
        return cls(limit, [])

    def insert(self, value: float, mass: float = 1.0) -> None:
        if math.isnan(value):
            return
        self._take([(value, mass)])

    def merge(self, other: FeatureHistogram) -> None:
        self._take(other.points)

    def _take(self, more: list[tuple[float, float]]) -> None:
        at: dict[float, float] = {}
        for x, m in sorted([*self.points, *more]):
            at[x] = at.get(x, 0.0) + m
        points = list(at.items())
        while len(points) > self.limit:
            gaps = [b[0] - a[0] for a, b in zip(points, points[1:], strict=False)]
            k = gaps.index(min(gaps))
            (x, m), (y, n) = points[k : k + 2]
            points[k : k + 2] = [((x * m + y * n) / (m + n), m + n)]
        self.points = points

    def count(self) -> float:
        return sum(m for _, m in self.points)

    def sum(self, b: float) -> float:
        """The number of values up to b, by the trapezoid rule between centroids; never more than all."""
        p = self.points
        if not p or b < p[0][0]:
            return 0.0
        if len(p) == 1 or b >= p[-1][0]:
            return self.count()
        k = max(i for i in range(len(p) - 1) if p[i][0] <= b)
        (x, m), (y, n) = p[k], p[k + 1]
        f = (b - x) / (y - x)
        at_b = m + (n - m) * f
        return sum(v for _, v in p[:k]) + m / 2 + (m + at_b) / 2 * f

    def uniform(self, parts: int) -> list[float]:
        """parts - 1 points that cut the mass into equal parts, within the centroids' range."""
        p = self.points
        if len(p) < 2:
            return []
        reach = [self.sum(x) for x, _ in p[:-1]] + [self.count() - p[-1][1] / 2]
        out = []
        for j in range(1, parts):
            s = j / parts * self.count()
            k = max((i for i in range(len(p) - 1) if reach[i] <= s), default=0)
            (x, m), (y, n) = p[k], p[k + 1]
            d, a = s - reach[k], n - m
            if d <= 0:
                z = 0.0
            elif abs(a) < 1e-12:
                z = d / m if m else 0.0
            else:
                z = (-2 * m + math.sqrt(max(4 * m * m + 8 * a * d, 0.0))) / (2 * a)
            out.append(x + (y - x) * min(max(z, 0.0), 1.0))
        return out

    def candidate_splits(self) -> list[float]:
        return self.uniform(self.limit) if len(self.points) > 1 else [x for x, _ in self.points]


@dataclass(frozen=True)
class Interval:
    left: float
    right: float
    count: int
    sum: float

    def compare(self, v: float) -> int:
        """-1, 0 or 1: the interval lies below v, holds it, or lies above."""
        return -1 if self.right < v else 1 if self.left > v else 0

    def join(self, other: Interval) -> Interval:
        return Interval(min(self.left, other.left), max(self.right, other.right), self.count + other.count, self.sum + other.sum)

    def partial_sum(self, r: int) -> float:
        """The sum of the r least values, taken as evenly spaced from left."""
        if not 0 <= r <= self.count:
            raise ValueError("r is out of range")
        if r == 0:
            return 0.0
        if r == self.count:
            return self.sum
        if self.count == 2:
            return self.left
        step = (self.sum - self.right - self.count * self.left + self.left) / ((self.count - 2) * (self.count - 1))
        return r * self.left + r * (r - 1) * step


class TargetHistogram:
    """Intervals with counts and sums, limit entries at most; the closest neighbours are joined, the first of equals.

    parity: a gap counts only once it is known, as in a known implementation: an insertion makes its two gaps known, a
    join the one to its right, a merge all of them. Of equal gaps the one known first is joined.
    """

    def __init__(self, limit: int, bins: list[Interval] | None = None, parity: bool = False):
        if limit < 1:
            raise ValueError("limit >= 1 is needed")
        self.limit, self.bins, self.parity = limit, list(bins or []), parity
        self.known: list[tuple[tuple[float, float], tuple[float, float]]] = []

    def insert(self, y: float, count: int = 1) -> None:
        if math.isnan(y):
            return
        for i, b in enumerate(self.bins):
            if b.compare(y) == 0:
                self.bins[i] = Interval(b.left, b.right, b.count + count, b.sum + y * count)
                return
        self.bins.append(Interval(y, y, count, y * count))
        self.bins.sort(key=lambda b: (b.left, b.right))
        at = next(i for i, b in enumerate(self.bins) if b.left == y == b.right)
        self._learn(at - 1, at)
        self._shrink()

    def merge(self, other: TargetHistogram) -> None:
        at = {(b.left, b.right): b for b in self.bins}
        for b in other.bins:
            k = (b.left, b.right)
            at[k] = at[k].join(b) if k in at else b
        self.bins = sorted(at.values(), key=lambda b: (b.left, b.right))
        self._learn(0, len(self.bins))
        self._shrink()

    def _learn(self, first: int, last: int) -> None:
        """The gaps to the right of bins first to last are known."""
        if self.parity:
            for a, b in zip(self.bins[max(first, 0) : last + 1], self.bins[max(first, 0) + 1 : last + 2], strict=False):
                self.known.append(((a.left, a.right), (b.left, b.right)))

    def _closest(self) -> int:
        places = range(len(self.bins) - 1)
        if self.parity:
            at = {((a.left, a.right), (b.left, b.right)): i for i, (a, b) in enumerate(zip(self.bins, self.bins[1:], strict=False))}
            places = [at[k] for k in self.known if k in at] or places
        return min(places, key=lambda i: max(self.bins[i + 1].left - self.bins[i].right, 0.0))

    def _shrink(self) -> None:
        while len(self.bins) > self.limit:
            k = self._closest()
            self.bins[k : k + 2] = [self.bins[k].join(self.bins[k + 1])]
            self._learn(k, k)

    def count(self) -> int:
        return sum(b.count for b in self.bins)

    def median(self) -> float | None:
        rest = self.count() // 2
        for b in self.bins:
            if rest < b.count:
                return b.left + (b.right - b.left) * rest / b.count
            rest -= b.count
        return None


def summarize(histograms: list):
    """All of them merged into one, or None."""
    if not histograms:
        return None
    first = histograms[0]
    out = FeatureHistogram.empty(first.limit) if isinstance(first, FeatureHistogram) else TargetHistogram(first.limit, parity=first.parity)
    for h in histograms:
        out.merge(h)
    return out
