"""Classification trees grown a level at a time from mergeable histograms."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.histograms import FeatureHistogram, feature_histogram, feature_histogram_exact, summarize
from ..operators.local_splits import best_split_local, small_rows
from ..operators.splits import best_split, gini_by_split, majority_label
from .tree import DecisionTree, Rule, route


@dataclass
class ClassificationModel:
    tree: DecisionTree
    features: list[str]
    kind: str

    def transform(self, df: DataFrame, name: str = "prediction", strict: bool = False) -> DataFrame:
        return self.tree.predict(df, self.features, name, strict, self.kind)


@dataclass
class StreamingClassificationTree:
    """levels splits from root to leaf at most; bins: None for exact counts, else entries of a histogram."""

    levels: int
    bins: int | None = None
    parity: bool = False

    def fit(self, df: DataFrame, features: list[str], label: str) -> ClassificationModel:
        if self.levels < 0:
            raise ValueError("levels >= 0 is needed")
        kind = dict(df.dtypes)[label]
        data = df.select(*features, F.col(label).alias("label")).where("label is not null").withColumn("node_id", F.lit(0)).persist()
        rows, tree, open_nodes = data, DecisionTree(), [0]
        for level in range(self.levels + 1):
            live = rows.where(F.col("node_id").isin(open_nodes)) if level else rows
            counts = live.groupBy("node_id", "label").agg(F.count("*").alias("n"))
            for r in majority_label(counts).collect():
                tree.label(r["node_id"], r["label"])
            splits = self._splits(live, features) if level < self.levels else []
            if not splits:
                break
            open_nodes = []
            for node, attr, threshold in splits:
                open_nodes += tree.split(node, Rule(attr, threshold))
            rows = route(rows, [(n, tree.nodes[n]) for n, _, _ in splits], features)
        data.unpersist()
        return ClassificationModel(tree, features, kind)

    def _splits(self, live: DataFrame, features: list[str]) -> list[tuple[int, int, float]]:
        """node, attr, threshold of each node to split: a row a leaf comes to the driver."""
        if self.bins is None:
            exact = feature_histogram_exact(live, features, "label").persist()
            rows = small_rows(exact)
            if rows is not None:
                exact.unpersist()
                return best_split_local(rows, self.parity)
            gains = gini_by_split(exact, parity=self.parity)
            return sorted((r["node_id"], r["attr"], r["threshold"]) for r in best_split(gains).collect())
        by_node: dict = defaultdict(lambda: defaultdict(dict))
        for r in feature_histogram(live, features, "label", self.bins).collect():  # leaves x attrs x labels rows of bins
            by_node[r["node_id"]][r["attr"]][r["label"]] = FeatureHistogram(self.bins, [(b["x"], b["y"]) for b in r["bins"]])
        out = []
        for node, attrs in sorted(by_node.items()):
            best = None
            for attr, hists in sorted(attrs.items()):
                for t in summarize(list(hists.values())).candidate_splits():
                    gain = gini_gain([(h.count(), h.sum(t)) for h in hists.values()], self.parity)
                    if gain is not None and gain > 1e-12 and (best is None or round(gain, 9) > round(best[0], 9)):
                        best = (gain, attr, t)
            if best:
                out.append((node, best[1], best[2]))
        return out


def gini_gain(sides: list[tuple[float, float]], parity: bool = False) -> float | None:
    """The gain of a split from each label's count and its part on the left; None where a side is empty."""
    n, s = sum(c for c, _ in sides), sum(x for _, x in sides)
    if not 0 < s < n:
        return None
    whole = 1 - sum((c / n) ** 2 for c, _ in sides)
    left = 1 - sum((x / s) ** 2 for _, x in sides)
    right = 1 - sum((1 - x / s) ** 2 if parity else ((c - x) / (n - s)) ** 2 for c, x in sides)
    return whole - s / n * left - (1 - s / n) * right
