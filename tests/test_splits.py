import random

import pytest
from pyspark.sql import functions as F

from grovekit.operators.histograms import feature_histogram, feature_histogram_exact, target_histogram, target_histogram_exact, upper_median
from grovekit.operators.local_splits import best_split_local, best_subset_local
from grovekit.operators.splits import best_split, best_subset, gini_by_split, majority_label, subset_losses, trimmed_lad, weighted_loss


def rows(spark, n=300):
    r = random.Random(3)
    data = [(r.randint(0, 2), float(r.randint(0, 6)), float(r.randint(0, 3)), r.randint(0, 4), r.choice("abc"), float(r.randint(0, 40))) for _ in range(n)]
    return spark.createDataFrame(data, "node_id int, x double, z double, k bigint, label string, y double")


@pytest.mark.parametrize("parity", [False, True])
def test_gini_on_the_driver_and_in_plans(spark, parity):
    exact = feature_histogram_exact(rows(spark), ["x", "z"], "label")
    plan = sorted((r.node_id, r.attr, r.threshold) for r in best_split(gini_by_split(exact, parity=parity)).collect())
    assert best_split_local(exact.collect(), parity) == plan and len(plan) == 3


def test_small_gains_split_on_the_driver_and_in_plans(spark):
    counts = [(0, 0, "a", 0.0, 100000), (0, 0, "b", 0.0, 100000), (0, 0, "a", 1.0, 100002), (0, 0, "b", 1.0, 99998)]  # a gain of 5e-11
    exact = spark.createDataFrame(counts, "node_id int, attr int, label string, value double, n bigint")
    plan = [(r.node_id, r.attr, r.threshold) for r in best_split(gini_by_split(exact)).collect()]
    assert best_split_local(exact.collect()) == plan == [(0, 0, 1.0)]


@pytest.mark.parametrize("trim", [1.0, 0.8])
def test_subsets_on_the_driver_and_in_plans(spark, trim):
    exact = target_histogram_exact(rows(spark), ["x", "z", "k"], "y")
    plan = sorted((r.node_id, r.attr, tuple(r.subset)) for r in best_subset(subset_losses(exact, trim)).collect())
    assert best_subset_local(exact.collect(), trim) == plan and len(plan) == 3


def test_trimmed_lad_and_median(spark):
    values = spark.createDataFrame([("g", float(v), 1) for v in (1, 2, 3, 4, 100)], "g string, y double, n bigint")
    whole = trimmed_lad(values, ["g"]).first()
    assert (whole.n, whole["median"], whole.loss) == (5, 3.0, 2 + 1 + 0 + 1 + 97)
    assert trimmed_lad(values, ["g"], 0.6).first().loss == 2.0
    assert [r[0] for r in spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1])], "g int, v array<int>").select("g", F.explode("v").alias("v")).groupBy("g").agg(upper_median("v").alias("m")).orderBy("g").select("m").collect()] == [3, 1]
    assert values.select(weighted_loss(F.lit(2.0), F.lit(1), F.lit(4.0), F.lit(3)).alias("w")).first().w == 3.5


def test_bounded_histograms_keep_their_mass(spark):
    data = rows(spark)
    for r in feature_histogram(data, ["x", "z"], "label", 4).collect():
        assert len(r.bins) <= 4 and len({b.x for b in r.bins}) == len(r.bins)
    total = sum(b.y for r in feature_histogram(data, ["x"], "label", 4).collect() for b in r.bins)
    assert total == 300
    bounded = target_histogram(data.select("k", "y"), ["k"], 5).collect()
    assert sum(b["count"] for r in bounded for b in r.bins) == 300 and all(len(r.bins) <= 5 for r in bounded)
    assert sum(b["sum"] for r in bounded for b in r.bins) == pytest.approx(data.agg(F.sum("y")).first()[0])


def test_majority_takes_the_least_of_equals(spark):
    counts = spark.createDataFrame([(0, "b", 2), (0, "a", 2), (1, "c", 1)], "node_id int, label string, n bigint")
    assert sorted((r.node_id, r.label, r.n) for r in majority_label(counts).collect()) == [(0, "a", 2), (1, "c", 1)]
