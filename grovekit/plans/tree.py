"""Decision trees as a list of nodes on the driver, a nodes table, a column expression and a broadcast join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """threshold: smaller values go left, others right; NaN and null go nowhere. subset: members go left, others right."""

    feature: int
    threshold: float | None = None
    subset: tuple | None = None

    def goes_left(self, value: Column) -> Column:
        if self.subset is not None:
            return value.isin(list(self.subset))
        return F.when(~F.isnan(value), value < self.threshold)


@dataclass
class Node:
    rule: Rule | None = None
    left: int | None = None
    right: int | None = None
    label: object = None

    @property
    def is_leaf(self) -> bool:
        return self.rule is None


@dataclass
class DecisionTree:
    """Node 0 is the root; a split appends its left, then its right node."""

    nodes: list[Node] = field(default_factory=lambda: [Node()])

    root = 0

    def split(self, node: int, rule: Rule) -> tuple[int, int]:
        n = self.nodes[node]
        if not n.is_leaf:
            raise ValueError(f"node {node} is split already")
        n.rule, n.left, n.right = rule, len(self.nodes), len(self.nodes) + 1
        self.nodes += [Node(), Node()]
        return n.left, n.right

    def label(self, node: int, label) -> None:
        self.nodes[node].label = label

    def unlabeled_leaves(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n.is_leaf and n.label is None]

    def depth(self, node: int = 0) -> int:
        n = self.nodes[node]
        return 0 if n.is_leaf else 1 + max(self.depth(n.left), self.depth(n.right))

    def descend(self, sample: list) -> list[int]:
        """The path from the root; it ends early at a value that no side takes."""
        path, at = [0], 0
        while not self.nodes[at].is_leaf:
            n = self.nodes[at]
            v = sample[n.rule.feature]
            if v is None or n.rule.subset is None and v != v:
                break
            left = v in n.rule.subset if n.rule.subset is not None else v < n.rule.threshold
            at = n.left if left else n.right
            path.append(at)
        return path

    def leaf_labels(self, strict: bool) -> list:
        """Each node's label as a leaf; not strict: of the nearest labelled ancestor where it has none."""
        out = [n.label for n in self.nodes]
        if not strict:
            for i, n in enumerate(self.nodes):
                for child in (n.left, n.right):
                    if child is not None and out[child] is None:
                        out[child] = out[i]
        return out

    def _case(self, features: list[Column], leaf, at: int = 0) -> Column:
        n = self.nodes[at]
        if n.is_leaf:
            return leaf(at)
        left = n.rule.goes_left(features[n.rule.feature])
        return F.when(left, self._case(features, leaf, n.left)).when(~left, self._case(features, leaf, n.right))

    def to_column(self, features: list[str | Column], strict: bool = False, kind: str = "double") -> Column:
        """The prediction as nested CASE WHEN. For trees up to about depth 8; deeper ones by predict()."""
        labels = self.leaf_labels(strict)
        columns = [F.col(c) if isinstance(c, str) else c for c in features]
        return self._case(columns, lambda i: F.lit(labels[i]).cast(kind))

    def leaf_column(self, features: list[str | Column]) -> Column:
        return self._case([F.col(c) if isinstance(c, str) else c for c in features], lambda i: F.lit(i))

    def predict(self, df: DataFrame, features: list[str], name: str = "prediction", strict: bool = False, kind: str = "double") -> DataFrame:
        if self.depth() <= 8:
            return df.withColumn(name, self.to_column(features, strict, kind))
        labels = self.leaf_labels(strict)
        spark = df.sparkSession
        table = spark.createDataFrame([(i, labels[i]) for i in range(len(labels)) if self.nodes[i].is_leaf], f"_leaf int, {name} {kind}")
        return self.assign_nodes(df, features, "_leaf").join(F.broadcast(table), "_leaf", "left").drop("_leaf")

    def nodes_frame(self, spark: SparkSession, label: str = "double") -> DataFrame:
        rows = [
            (i, n.is_leaf, n.rule.feature if n.rule else None, n.rule.threshold if n.rule else None, list(n.rule.subset) if n.rule and n.rule.subset is not None else None, n.left, n.right, n.label)
            for i, n in enumerate(self.nodes)
        ]
        return spark.createDataFrame(rows, f"node_id int, is_leaf boolean, feature int, threshold double, subset array<bigint>, left int, right int, label {label}")

    @classmethod
    def from_rows(cls, rows) -> DecisionTree:
        nodes = []
        for r in sorted(rows, key=lambda r: r["node_id"]):
            rule = None if r["is_leaf"] else Rule(r["feature"], r["threshold"], tuple(r["subset"]) if r["subset"] is not None else None)
            nodes.append(Node(rule, r["left"], r["right"], r["label"]))
        return cls(nodes)

    def assign_nodes(self, df: DataFrame, features: list[str], name: str = "node_id", path: str | None = None) -> DataFrame:
        """The node each row ends in (and the path, if named), a level at a time: each level is a broadcast join with its
        split nodes, so that plans grow with the depth and not with the number of nodes."""
        out = df.withColumn(name, F.lit(0))
        if path:
            out = out.withColumn(path, F.array(F.lit(0)))
        level = [0]
        while split := [i for i in level if not self.nodes[i].is_leaf]:
            out = route(out, [(i, self.nodes[i]) for i in split], features, name, path)
            level = [c for i in split for c in (self.nodes[i].left, self.nodes[i].right)]
        return out


def route(df: DataFrame, split: list[tuple[int, Node]], features: list[str], name: str = "node_id", path: str | None = None) -> DataFrame:
    """Moves rows of split nodes to the children. The split nodes of a level are few: a tree's width, broadcast."""
    rows = [(i, n.rule.feature, n.rule.threshold, [float(v) for v in n.rule.subset] if n.rule.subset is not None else None, n.left, n.right) for i, n in split]
    table = df.sparkSession.createDataFrame(rows, "_n int, _f int, _t double, _s array<double>, _l int, _r int")
    value = F.get(F.array(*(F.col(c).cast("double") for c in features)), F.col("_f"))
    known = value.isNotNull() & (F.col("_s").isNotNull() | ~F.isnan(value))
    left = F.when(F.col("_s").isNotNull(), F.array_contains("_s", value)).otherwise(value < F.col("_t"))
    to = F.when(F.col("_n").isNull() | ~known, F.col(name)).when(left, F.col("_l")).otherwise(F.col("_r"))
    joined = df.join(F.broadcast(table), F.col(name) == F.col("_n"), "left").withColumn("_to", to)
    if path:
        joined = joined.withColumn(path, F.when(F.col("_to") != F.col(name), F.concat(path, F.array("_to"))).otherwise(F.col(path)))
    return joined.withColumn(name, F.col("_to")).drop("_n", "_f", "_t", "_s", "_l", "_r", "_to")
