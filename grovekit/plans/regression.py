"""Regression trees on discrete features: subset rules by trimmed least absolute deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.histograms import target_histogram_exact, unpivot, weighted_upper_median
from ..operators.local_splits import best_subset_local, small_rows
from ..operators.quantiles import weighted_quantiles
from ..operators.splits import best_subset, subset_losses
from .tree import DecisionTree, Rule, route


#: Bounded targets: shares of the rows between which cells are laid, and cells for each of the bins.
EDGES, CELLS = (0.005, 0.995), 8


def count_alike(df: DataFrame, features: list[str], target: str, weight: str) -> DataFrame:
    """Features and targets that are numbers, once each, and how many rows have them. Nothing that a tree learns from rows
    is lost, and what is done for each level and stage no longer grows with rows that repeat."""
    rows = df.select(*(F.col(f).cast("bigint") for f in features), F.col(target).cast("double").alias(target))
    return rows.where(F.col(target).isNotNull() & ~F.isnan(target)).groupBy(*features, target).agg(F.count("*").alias(weight))


@dataclass
class RegressionModel:
    tree: DecisionTree
    features: list[str]

    def transform(self, df: DataFrame, name: str = "prediction", strict: bool = False) -> DataFrame:
        return self.tree.predict(df, self.features, name, strict, "double")


@dataclass
class StreamingRegressionTree:
    """A node splits whenever some feature has two values, down to levels. bins: None for exact targets, else CELLS * bins
    (and two) cells at most stand for the targets of a feature value. Labels are upper medians; with bins lower ones,
    found in bounded memory."""

    levels: int
    bins: int | None = None
    trim_ratio: float = 1.0
    min_gain: float | None = None

    def fit(self, df: DataFrame, features: list[str], target: str, weight: str | None = None) -> RegressionModel:
        """weight: the column that tells how many rows a row stands for; without it, equal rows are counted first."""
        if self.levels < 0 or not 0 < self.trim_ratio <= 1:
            raise ValueError("levels >= 0 and 0 < trim_ratio <= 1 are needed")
        if weight is None:
            df, weight = count_alike(df, features, target, "_rows"), "_rows"
        data = df.select(*(F.col(f).cast("bigint") for f in features), F.col(target).cast("double").alias("y"), F.col(weight).alias("_rows"))
        data = data.where("y is not null and not isnan(y)").withColumn("node_id", F.lit(0)).persist()
        rows, tree, open_nodes = data, DecisionTree(), [0]
        root = weighted_quantiles(data, "node_id", "y", "_rows", [EDGES[0], 0.5, EDGES[1]]).get(0) if self.bins is not None else None
        bounds = (root[0], root[2]) if root else None
        for level in range(self.levels + 1):
            live = rows.where(F.col("node_id").isin(open_nodes)) if level else rows
            for node, median in ({0: root[1]} if root and not level else self._medians(live, bounds)).items():
                tree.label(node, median)
            if level == self.levels:
                break
            exact = self._targets(live, features, bounds).persist()
            small = small_rows(exact)
            if small is not None:
                splits = best_subset_local(small, self.trim_ratio)
            else:
                splits = [(r["node_id"], r["attr"], tuple(r["subset"])) for r in best_subset(subset_losses(exact, self.trim_ratio)).collect()]
            exact.unpersist()
            if not splits:
                break
            open_nodes = []
            for node, attr, subset in sorted(splits):
                open_nodes += tree.split(node, Rule(attr, subset=subset))
            rows = route(rows, [(n, tree.nodes[n]) for n, _, _ in splits], features)
        data.unpersist()
        return RegressionModel(tree, features)

    def _medians(self, live: DataFrame, bounds: tuple[float, float] | None) -> dict[int, float]:
        if self.bins is None:
            return {r["node_id"]: r["median"] for r in weighted_upper_median(live, ["node_id"], n="_rows").collect()}
        return {node: median for node, (median,) in weighted_quantiles(live, "node_id", "y", "_rows", [0.5], bounds).items()}

    def _targets(self, live: DataFrame, features: list[str], bounds: tuple[float, float] | None) -> DataFrame:
        if self.bins is None:
            return target_histogram_exact(live, features, "y", weight="_rows")
        if bounds is None:
            return target_histogram_exact(live.limit(0), features, "y", weight="_rows")
        low, high = bounds
        n = CELLS * max(self.bins, 2)
        # cells of equal width between the edges and one on either side; a feature value's targets in a cell stand at their mean
        cell = F.width_bucket("y", F.lit(low), F.lit(high), F.lit(n)) if low < high else (F.col("y") > low).cast("int") + (F.col("y") >= low).cast("int")
        long = unpivot(live.withColumn("cell", cell), features, ["node_id", "y", "cell", "_rows"], "bigint")
        counts = long.groupBy("node_id", "attr", "value", "cell").agg((F.sum(F.col("y") * F.col("_rows")) / F.sum("_rows")).alias("y"), F.sum("_rows").alias("n"))
        return counts.select("node_id", "attr", "value", "y", "n")
