import pandas as pd
import pytest
from pyspark.sql import functions as F

from grovekit.functions import vectors
from grovekit.operators import flow
from grovekit.sources import csv
from grovekit.sources.random import Constant, NormalParams, RandomClassification, RandomRegression, UniformParams
from grovekit.sources.rows import array_source, chunk_indices, count_rows, fetch_items, number_rows, select_rows, slice_rows
from grovekit.streaming.training import LatestModel, start


def test_rows(spark):
    rows = number_rows(spark.range(10, 0, -1).select(F.col("id").alias("k")), ["k"])
    assert [r.k for r in slice_rows(rows, 2, 2).orderBy("k").collect()] == [3, 4]
    assert [r.k for r in select_rows(rows, [9, 0, 0]).orderBy("position").collect()] == [10, 1, 1]
    assert [(r.start, r.length) for r in chunk_indices(count_rows(spark.range(6)), 4).orderBy("start").collect()] == [(0, 4), (4, 2)]
    assert chunk_indices(count_rows(spark.range(0)), 4).count() == 0
    slices = spark.createDataFrame([(0, 3, 4), (1, 9, 5)], "epoch int, start bigint, length bigint")
    assert sorted((r.epoch, r.k) for r in fetch_items(slices, rows, 4).collect()) == [(0, 4), (0, 5), (0, 6), (0, 7), (1, 10)]
    assert array_source(spark, [[1.0, 2.0]]).first().features == [1.0, 2.0]


def test_csv(spark, tmp_path):
    lines = spark.createDataFrame([("string,11,22.0",), ("string2,44,55.0",)], "value string")
    assert [tuple(r) for r in csv.csv_strings(lines, "a string, b bigint, c double").collect()] == [("string", 11, 22.0), ("string2", 44, 55.0)]
    data = spark.createDataFrame([([1.0, 2.0], 3.0), ([4.0, 5.0], 6.0)], "features array<double>, target double")
    csv.training_data_to_csv(data, str(tmp_path / "t"), 2)
    back = csv.training_data_from_csv(spark, str(tmp_path / "t"), 2)
    assert sorted((tuple(r.features), r.target) for r in back.collect()) == [((1.0, 2.0), 3.0), ((4.0, 5.0), 6.0)]
    (tmp_path / "bad.csv").write_text("1,x\n")
    with pytest.raises(Exception):  # noqa: B017
        csv.csv_file(spark, str(tmp_path / "bad.csv"), "a int, b int").collect()


def test_time_aligned(spark):
    events = spark.createDataFrame([(0, 5), (1, 6), (1, 7), (4, 8)], "epoch int, v int")
    models = spark.createDataFrame([(1, "a"), (3, "b")], "version int, m string")
    assert sorted((r.v, r.m) for r in flow.apply_latest(models, events).collect()) == [(5, "a"), (6, "a"), (7, "a"), (8, "b")]
    assert sorted((r.epoch, list(r.items)) for r in flow.extract_by_time(events, "v").select("epoch", F.col("items")).collect() for r in [r.asDict() and type("R", (), r.asDict())]) == [(0, [5]), (1, [6, 7]), (4, [8])]
    other = spark.createDataFrame([(1, 1), (9, 2)], "epoch int, v int")
    count = lambda a, b: pd.DataFrame({"epoch": [(a if len(a) else b).epoch.iloc[0]], "n": [len(a)], "m": [len(b)]})
    got = flow.combine_each_time(events, other, count, "epoch int, n int, m int")
    assert sorted(map(tuple, got.collect())) == [(0, 1, 0), (1, 2, 1), (4, 1, 0), (9, 0, 1)]
    assert flow.init_each_time(events, spark.createDataFrame([(1,), (2,)], "k int")).count() == 6
    chunks = spark.createDataFrame([(0, 4), (1, 2), (2, 3)], "chunk_id int, length int")
    assert [r.start for r in flow.index_data(chunks).orderBy("chunk_id").collect()] == [0, 4, 6]
    rest, small = flow.branch(events, F.col("v") < 7)
    assert (rest.count(), small.count()) == (2, 2) and flow.concat(rest, small).count() == 4
    assert [p.count() for p in flow.partition(events, 2, F.col("v") % 2)] == [2, 2]
    assert flow.exchange_evenly(events, 3).count() == 4 and flow.timed(lambda: 5)[0] == 5
    assert flow.latest_rows(events, "v", 1).first().v == 8


def test_random_sources_do_not_depend_on_partitions(spark):
    source = RandomClassification(samples=200, chunks=2, rounds=3, seed=1, x_distributions=[[NormalParams(m, 1.0)] * 3 for m in (1, 2, 4)], y_distributions=[Constant(k) for k in range(3)])
    rows = source.frame(spark)
    assert rows.groupBy("epoch", "chunk").count().where("count = 200").count() == 6
    assert sorted(rows.collect()) == sorted(source.frame(spark).repartition(3).collect())
    assert rows.groupBy("y").agg(F.avg("f0").alias("m")).where("abs(m - case y when 2 then 4 when 1 then 2 else 1 end) > 0.4").count() == 0
    line = RandomRegression(samples=500, seed=2, x_distributions=[UniformParams(0, 20)] * 2, mapper=lambda x: ([x[0], x[1]], 0.6 * x[0] - x[1])).frame(spark)
    assert line.where("f0 < 0 or f0 >= 20 or abs(y - (0.6 * f0 - f1)) > 1e-9").count() == 0


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = r.select(vectors.l2_distance(a, b), vectors.l2_norm(a), vectors.add(a, a), vectors.divide(a, b), vectors.scale(a, 2.0), vectors.ndarray_item(vectors.ndarray([1, 2], [2, 1], a), 0, 1)).first()
    assert tuple(got) == (5.0, 5.0, [6.0, 8.0], [None, None], [6.0, 8.0], 4.0)


def test_latest_model_in_a_stream(spark, tmp_path):
    class Mean:
        def __init__(self, value):
            self.value = value

        def transform(self, df):
            return df.withColumn("prediction", F.lit(self.value))

    for i, values in enumerate(([1.0, 3.0], [10.0], [20.0])):
        spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state, out = LatestModel(), []
    fit = lambda df: Mean(df.agg(F.avg("v")).first()[0])
    query = start(stream, state.predict_then_train(fit, lambda df, i: out.extend((i, r.v, r.prediction) for r in df.collect())), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert state.batch_id == 2 and len(out) == 4 and {i for i, _, _ in out} == {1, 2}
