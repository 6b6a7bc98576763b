"""Weighted quantiles against sorted lists, and models of rows that repeat: they learn the same, from each row once."""

import math
import random

import pytest
from pyspark.sql import functions as F

from grovekit.operators.quantiles import weighted_quantiles
from grovekit.plans import regression
from grovekit.plans.boosting import GradientBoostingRegression
from grovekit.plans.regression import StreamingRegressionTree

SHARES = [0.005, 0.5, 0.995]


@pytest.mark.parametrize("grid", [None, (7.0, 7.0)])
def test_weighted_quantiles(spark, grid):
    r = random.Random(1)
    values = {
        0: [r.gauss(0, 1) for _ in range(400)],
        1: [float(r.randint(0, 9)) for _ in range(400)],
        2: [r.choice((-1, 1)) * 10.0 ** r.uniform(-300, 300) for _ in range(400)],
        3: [math.inf, -math.inf, 1.7e308, -1.7e308, 5e-324, 0.0, -5e-324, 1e-320],
        4: [math.nextafter(1.0, 2.0), 1.0],
        5: [-math.inf] * 3,
    }
    rows = [(k, y, r.choice((1, 1, 2, 50))) for k, ys in values.items() for y in ys]
    got = weighted_quantiles(spark.createDataFrame(rows, "g int, y double, n bigint"), "g", "y", "n", SHARES, grid)
    assert weighted_quantiles(spark.createDataFrame([], "g int, y double, n bigint"), "g", "y", "n", SHARES, grid) == {}
    for k in values:
        whole = sorted(y for g, y, n in rows if g == k for _ in range(n))
        assert got[k] == [whole[max(1, math.ceil(s * len(whole))) - 1] for s in SHARES]


@pytest.mark.parametrize("bins", [None, 8])
def test_rows_that_repeat_are_learned_once(spark, monkeypatch, bins):
    r = random.Random(2)
    once = [(r.choice((None, 0, 1, 2, 3)), r.randint(0, 4), float(r.randint(0, 60))) for _ in range(300)]
    read = []

    def counted(df, *a, f=regression.unpivot, **b):
        read.append(df.count())
        return f(df, *a, **b)

    monkeypatch.setattr(regression, "unpivot", counted)
    monkeypatch.setattr("grovekit.operators.histograms.unpivot", counted)
    chains = []
    for copies in (1, 20):
        rows = spark.createDataFrame(once, "x bigint, z bigint, y double").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        chains.append(GradientBoostingRegression(3, StreamingRegressionTree(levels=2, bins=bins), 0.3).fit(rows, ["x", "z"], "y"))
    assert max(read) <= len(set(once))
    one, many = chains
    for (_, a), (_, b) in zip(one.items, many.items, strict=True):
        assert [(n.rule, n.left, n.right) for n in a.nodes] == [(n.rule, n.left, n.right) for n in b.nodes]
        assert [n.label for n in b.nodes] == pytest.approx([n.label for n in a.nodes])
