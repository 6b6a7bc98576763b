import pytest
from pyspark.sql import functions as F

from grovekit.functions.metrics import incorrect_ratio, mae, prediction_error, rmse
from grovekit.functions.quantize import NormalQuantizer, UniformQuantizer
from grovekit.plans.boosting import BoostChain, GradientBoostingRegression
from grovekit.plans.classification import StreamingClassificationTree, gini_gain
from grovekit.plans.kmeans import ConvergenceCriteria, KMeans, KMeansPlusPlus, RandomSample
from grovekit.plans.regression import StreamingRegressionTree
from grovekit.plans.tree import DecisionTree, Rule


def colour_tree():
    tree = DecisionTree()
    red, other = tree.split(0, Rule(0, subset=(1,)))
    not_green, green = tree.split(red, Rule(1, subset=(0,)))
    for node, label in ((other, 1.0), (not_green, 2.0), (green, 3.0)):
        tree.label(node, label)
    return tree


def test_tree_arena_and_paths(spark):
    tree = DecisionTree()
    assert tree.split(0, Rule(0, threshold=1.0)) == (1, 2) and tree.split(2, Rule(0, threshold=2.0)) == (3, 4) and tree.split(3, Rule(0, threshold=1.5)) == (5, 6)
    with pytest.raises(ValueError):
        tree.split(0, Rule(0, threshold=1.0))
    tree = colour_tree()
    assert tree.descend([1, 0, 0]) == [0, 1, 3] and tree.descend([1, 1, 0]) == [0, 1, 4] and tree.descend([0, 0, 1]) == [0, 2]
    rows = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (0, 0, 1), (None, 0, 0)], "a int, b int, c int")
    routed = tree.assign_nodes(rows, ["a", "b", "c"], path="path")
    got = {(r.a, r.b): list(r.path) for r in routed.collect()}
    assert got == {(1, 0): [0, 1, 3], (1, 1): [0, 1, 4], (0, 0): [0, 2], (None, 0): [0]}
    predicted = {(r.a, r.b): r.prediction for r in tree.predict(rows, ["a", "b", "c"]).collect()}
    assert predicted == {(1, 0): 2.0, (1, 1): 3.0, (0, 0): 1.0, (None, 0): None}
    again = DecisionTree.from_rows(tree.nodes_frame(spark).collect())
    assert [n.label for n in again.nodes] == [n.label for n in tree.nodes] and again.descend([1, 1, 0]) == [0, 1, 4]


def test_threshold_sides_and_missing_values(spark):
    tree = DecisionTree()
    left, right = tree.split(0, Rule(0, threshold=2.0))
    tree.label(left, 1.0)
    rows = spark.createDataFrame([(1.9,), (2.0,), (float("nan"),), (None,)], "x double")
    strict = [r.prediction for r in tree.predict(rows, ["x"], strict=True).collect()]
    assert strict == [1.0, None, None, None]
    tree.label(0, 9.0)
    assert [r.prediction for r in tree.predict(rows, ["x"]).collect()] == [1.0, 9.0, None, None]


def test_deep_tree_predicts_by_join(spark):
    tree, node = DecisionTree(), 0
    for k in range(10):
        left, node = tree.split(node, Rule(0, threshold=float(k + 1)))
        tree.label(left, float(k))
    tree.label(node, 10.0)
    rows = spark.range(12).select(F.col("id").cast("double").alias("x"))
    assert {r.x: r.prediction for r in tree.predict(rows, ["x"]).collect()} == {float(i): float(min(i, 10)) for i in range(12)}


def test_quantizers(spark):
    q = UniformQuantizer(0, 20, 20)
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 19.999, 20.0, float("nan"), None)], "v double")
    assert [r[0] for r in rows.select(q.quantize("v")).collect()] == [0, 1, 1, 2, 20, 21, None, None]
    n = NormalQuantizer(0, 5, 20)
    assert n.thresholds()[0] == pytest.approx(-8.224268, abs=1e-6)
    edge = spark.createDataFrame([(n.thresholds()[0],), (-100.0,), (100.0,)], "v double")
    assert [r[0] for r in edge.select(n.quantize("v")).collect()] == [0, 0, 19]
    with pytest.raises(ValueError):
        UniformQuantizer(1, 1, 3)


def test_error_measures(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "y double, p double")
    r = rows.agg(mae(F.col("p"), F.col("y")), rmse(F.col("p"), F.col("y")), incorrect_ratio(F.col("p"), F.col("y"))).first()
    assert tuple(r) == (1.5, pytest.approx(1.5811, abs=1e-4), 1.0)
    assert prediction_error(rows, mae, "p", "y").first()["error"] == 1.5


def test_classification(spark):
    rows = spark.createDataFrame([(float(i), float(i % 3), "a" if i < 10 else "b" if i < 20 else "c") for i in range(30)] + [(None, 1.0, "a"), (1.0, 1.0, None)], "x double, z double, label string")
    for bins in (None, 12):
        model = StreamingClassificationTree(levels=3, bins=bins).fit(rows, ["x", "z"], "label")
        wrong = model.transform(rows.where("x is not null and label is not null")).where("prediction <> label").count()
        assert wrong <= (0 if bins is None else 3)
    assert gini_gain([(5, 5), (5, 0)]) == pytest.approx(0.5) and gini_gain([(5, 0)]) is None
    only_root = StreamingClassificationTree(levels=0).fit(rows, ["x"], "label")
    assert {r.prediction for r in only_root.transform(rows).collect()} == {"a"}


PAIRS = [(x, y) for x, y in ((0, 10.0), (1, 12.0), (2, 14.0), (3, 16.0)) for _ in range(4)]


def test_regression(spark):
    rows = spark.createDataFrame(PAIRS, "x bigint, y double")
    for bins in (None, 5):
        model = StreamingRegressionTree(levels=2, bins=bins).fit(rows, ["x"], "y")
        assert model.tree.nodes[0].rule.subset == (0, 1)
        assert {(r.x, r.prediction) for r in model.transform(rows).collect()} == {(0, 10.0), (1, 12.0), (2, 14.0), (3, 16.0)}
    unseen = spark.createDataFrame([(7,)], "x bigint")
    assert StreamingRegressionTree(levels=1).fit(rows, ["x"], "y").transform(unseen).first().prediction == 16.0


def test_boosting(spark):
    rows = spark.createDataFrame(PAIRS, "x bigint, y double")
    one = GradientBoostingRegression(1, StreamingRegressionTree(levels=1), 0.2).fit(rows, ["x"], "y")
    assert {round(r.prediction, 9) for r in one.transform(rows).collect()} == {2.4, 3.2}
    many = GradientBoostingRegression(4, StreamingRegressionTree(levels=2), 0.5, cut_every=2).fit(rows, ["x"], "y")
    assert many.transform(rows).agg(mae(F.col("prediction"), F.col("y"))).first()[0] < 1.0
    assert BoostChain(0.1, ["x"]).transform(rows).first().prediction == 0.0


def test_kmeans(spark):
    rows = spark.createDataFrame([(i, [0.0] * 5 if i < 4 else [5.0] * 5) for i in range(8)], "row_id bigint, features array<double>")
    for init in (RandomSample(1), KMeansPlusPlus(1)):
        model = KMeans(2, 5, ConvergenceCriteria().limit_iterations(5).centroid_change(0.5), init).fit(rows)
        assert sorted(model.centroids) == [[0.0] * 5, [5.0] * 5]
    same = KMeans(2, 5, ConvergenceCriteria(5)).fit(rows, initial=[[0.0] * 5, [0.0] * 5])
    assert sorted(same.centroids) == [[0.0] * 5, [5.0] * 5]
    assert not ConvergenceCriteria().converges([[0.0]], [[0.0]], 99)
    with pytest.raises(ValueError):
        KMeans(2, 5, ConvergenceCriteria(0)).fit(rows)


def test_bounded_tree_takes_all_of_an_embedding(spark, tmp_path):
    from grovekit.queries import QUERIES

    rows = [([0.5] * 63 + [float(i % 2)], i % 2) for i in range(40)]  # the last entry alone tells the label
    spark.createDataFrame(rows, "embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["ctree_bounded_nodes"](spark, str(tmp_path)).where("node_id = 0").first().feature == 63
