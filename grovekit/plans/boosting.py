"""Gradient boosting of regression trees on residuals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import drop_table
from .lineage import cut_lineage
from .regression import StreamingRegressionTree, count_alike
from .tree import DecisionTree


@dataclass
class BoostChain:
    """The sum of learning_rate * multiplier * tree, and of a constant start; an empty chain predicts the start."""

    learning_rate: float
    features: list[str]
    items: list[tuple[float, DecisionTree]] = field(default_factory=list)
    start: float = 0.0

    def push_item(self, multiplier: float, tree: DecisionTree) -> None:
        self.items.append((multiplier, tree))

    def to_column(self) -> Column:
        out = F.lit(self.start)
        for m, tree in self.items:
            out = out + F.lit(self.learning_rate * m) * tree.to_column(self.features)
        return out

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Stages are added in groups, so that no expression grows with the whole chain."""
        out = df.withColumn(name, F.lit(self.start))
        for k in range(0, len(self.items), 25):
            part = BoostChain(self.learning_rate, self.features, self.items[k : k + 25])
            out = out.withColumn(name, F.col(name) + part.to_column())
        return out


@dataclass
class GradientBoostingRegression:
    """Each stage fits the inner tree to what is left of the target; all multipliers are 1 and the start is 0 unless
    init is mean. Rows of the same features and target have the same residual at each stage, so they are counted once and
    the stages work on the counts. Every cut_every stages the residuals are written, so that a stage's lineage stays short."""

    iterations: int
    inner: StreamingRegressionTree
    learning_rate: float
    init: str = "zero"
    cut_every: int = 1

    def fit(self, df: DataFrame, features: list[str], target: str) -> BoostChain:
        if self.iterations < 1:
            raise ValueError("iterations >= 1 is needed")
        data = df.select(*features, F.col(target).alias("residual"))
        data = table = cut_lineage(count_alike(data, features, "residual", "_rows"))
        chain = BoostChain(self.learning_rate, features)
        if self.init == "mean":
            chain.start = data.agg(F.sum(F.col("residual") * F.col("_rows")) / F.sum("_rows")).first()[0] or 0.0
            data = data.withColumn("residual", F.col("residual") - chain.start)
        for stage in range(self.iterations):
            tree = self.inner.fit(data, features, "residual", "_rows").tree
            chain.push_item(1.0, tree)
            step = F.lit(self.learning_rate) * tree.to_column(features)
            data = data.withColumn("residual", F.col("residual") - F.coalesce(step, F.lit(0.0)))
            if (stage + 1) % self.cut_every == 0 and stage + 1 < self.iterations:
                data = cut_lineage(data)
                drop_table(table)
                table = data
        drop_table(table)
        return chain
