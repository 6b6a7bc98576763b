"""Split measures: Gini gain of thresholds over label counts, trimmed least absolute deviation of subsets of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gini_by_split(exact: DataFrame, node: str = "node_id", label: str = "label", parity: bool = False) -> DataFrame:
    """node, attr, threshold, n_left, n, gain for each value as a threshold (values below it go left).

    exact has node, attr, label, value, n. Label counts up to a value come from one running sum for each (node, attr,
    label); rows are distinct values, not samples. parity: the right side's impurity from 1 - s/S in place of
    (c - s)/(n - S), as a known implementation has it. The least value is no threshold: nothing is below it.
    """
    labels = exact.groupBy(node, "attr", label).agg(F.sum("n").alias("c"))
    values = exact.select(node, "attr", "value").distinct()
    grid = values.join(labels, [node, "attr"]).join(exact, [node, "attr", label, "value"], "left")
    upto = W.partitionBy(node, "attr", label).orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    left = grid.withColumn("s", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    sums = left.groupBy(node, "attr", F.col("value").alias("threshold")).agg(
        F.sum("c").alias("n"), F.sum("s").alias("n_left"),
        F.sum(F.col("c").cast("double") * F.col("c")).alias("cc"), F.sum(F.col("s").cast("double") * F.col("s")).alias("ss"),
        F.sum((F.col("c") - F.col("s")).cast("double") * (F.col("c") - F.col("s"))).alias("rr"), F.count("*").alias("k"),
    ).where("n_left > 0 and n_left < n")
    n, s = F.col("n").cast("double"), F.col("n_left").cast("double")
    p, whole, small = s / n, 1 - F.col("cc") / (n * n), 1 - F.col("ss") / (s * s)
    right = 1 - (F.col("k") - 2 + F.col("ss") / (s * s)) if parity else 1 - F.col("rr") / ((n - s) * (n - s))
    return sums.select(node, "attr", "threshold", F.col("n_left").cast("bigint").alias("n_left"), F.col("n").cast("bigint").alias("n"), (whole - p * small - (1 - p) * right).alias("gain"))


def best_split(gains: DataFrame, node: str = "node_id") -> DataFrame:
    """node, attr, threshold, gain: the greatest gain (to 9 places), of equals the least attr, then threshold."""
    best = F.max_by(F.struct("attr", "threshold", "gain"), F.struct(F.round("gain", 9), -F.col("attr"), -F.col("threshold")))
    return gains.groupBy(node).agg(best.alias("b")).select(node, "b.*").where("gain > 1e-12")


def majority_label(counts: DataFrame, node: str = "node_id", label: str = "label", n: str = "n") -> DataFrame:
    """node, label, n: the most frequent label, of equals the least."""
    summed = counts.groupBy(node, label).agg(F.sum(n).alias("_n"))
    top = summed.groupBy(node).agg(F.max("_n").alias("n"))
    return summed.join(top, node).where("_n = n").groupBy(node).agg(F.min(label).alias(label), F.first("n").cast("bigint").alias("n"))


def trimmed_lad(values: DataFrame, keys: list[str], trim: float = 1.0, y: str = "y", n: str = "n") -> DataFrame:
    """keys, n, median, loss: the sum of |y - upper median| over the ranks from round((1 - trim) / 2 * n) on, trim * n of them.

    values has (y, n) counts. Ranks of a value are one running sum; a value at an edge of the trimmed part counts with
    the rows inside it.
    """
    w = W.partitionBy(*keys)
    summed = values.groupBy(*keys, y).agg(F.sum(n).alias("_n"))
    ranked = summed.withColumn("_to", F.sum("_n").over(w.orderBy(y))).withColumn("_all", F.sum("_n").over(w))
    ranked = ranked.withColumn("_mid", F.min(F.when(F.col("_to") > F.floor(F.col("_all") / 2), F.col(y))).over(w))
    low = F.floor(F.lit(round((1 - trim) / 2, 12)) * F.col("_all") + 0.5)
    inside = F.greatest(F.lit(0), F.least("_to", F.col("_all") - low) - F.greatest(F.col("_to") - F.col("_n"), low))
    return ranked.groupBy(*keys).agg(
        F.first("_all").cast("bigint").alias("n"), F.first("_mid").alias("median"), F.sum(inside * F.abs(F.col(y) - F.col("_mid"))).alias("loss")
    )


def weighted_loss(left_loss: Column, left_n: Column, right_loss: Column, right_n: Column) -> Column:
    """Losses weighted by the sides' shares of the rows."""
    return left_loss * left_n / (left_n + right_n) + right_loss * right_n / (left_n + right_n)


def subset_losses(exact: DataFrame, trim: float = 1.0, node: str = "node_id") -> DataFrame:
    """node, attr, cut, loss, subset: each prefix of an attribute's values, in order of their target medians, as a left side.

    exact has node, attr, value, y, n. A cut repeats its attribute's counts once for each side, so the work is values
    times cuts on counts already aggregated.
    """
    from .histograms import weighted_upper_median

    key = [node, "attr"]
    medians = weighted_upper_median(exact, [*key, "value"])
    order = medians.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy("median", "value")))
    order = order.withColumn("cuts", F.count("*").over(W.partitionBy(*key)))
    cuts = exact.join(order.select(*key, "value", "place", "cuts"), [*key, "value"]).where("cuts > 1").withColumn("cut", F.explode(F.expr("sequence(1, cast(cuts as int) - 1)")))
    sides = trimmed_lad(cuts.withColumn("is_left", F.col("place") <= F.col("cut")), [*key, "cut", "is_left"], trim)
    losses = sides.groupBy(*key, "cut").agg(
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"), F.sum("n").cast("bigint").alias("n")
    )
    listed = order.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("_v"))
    prefix = F.array_sort(F.transform(F.slice("_v", F.lit(1), F.col("cut")), lambda x: x["value"]))
    return losses.join(listed, key).select(*key, "cut", "n", "loss", prefix.alias("subset"))


def best_subset(losses: DataFrame, node: str = "node_id") -> DataFrame:
    """node, attr, cut, loss, subset: the least loss (to 9 places), of equals the least attr, then cut."""
    best = F.min_by(F.struct("attr", "cut", "loss", "subset"), F.struct(F.round("loss", 9), "attr", "cut"))
    return losses.groupBy(node).agg(best.alias("b")).select(node, "b.*")
