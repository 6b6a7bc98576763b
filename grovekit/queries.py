"""Registered queries of the core operators, each over its whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.metrics import incorrect_ratio, mae, prediction_error, rmse
from .functions.quantize import NormalQuantizer, UniformQuantizer
from .oracle_sql import boosted_counts, classification_nodes, lloyd_ctes, nearest_cte, plus_plus_ctes, regression_nodes
from .operators import flow, histograms, splits
from .plans.boosting import GradientBoostingRegression
from .plans.classification import StreamingClassificationTree
from .plans.kmeans import ConvergenceCriteria, KMeans, KMeansPlusPlus, RandomSample, accumulate, estimate, nearest
from .plans.regression import StreamingRegressionTree
from .plans.tree import DecisionTree, Rule
from .scratch import new_folder
from .sources.csv import csv_file
from .sources.random import NormalParams, RandomClassification, RandomRegression
from .sources.rows import chunk_indices, count_rows, fetch_items, number_rows, select_rows, slice_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- data the queries share -----------------------------------------------------------------------------------------

CLASS_FEATURES = ["l_quantity", "l_discount", "l_tax"]
VALUE_FEATURES = ["linenumber", "discount", "tax"]


def class_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*CLASS_FEATURES, F.col("l_returnflag").alias("label"), F.lit(0).alias("node_id"))


def value_rows(spark, sf_dir) -> DataFrame:
    """Discrete features; targets in whole hundreds, so that sums are exact in any order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("linenumber"), F.round(F.col("l_discount") * 100).cast("bigint").alias("discount"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"), F.floor(F.col("l_extendedprice") / 100).cast("double").alias("y"), F.lit(0).alias("node_id"),
    )


VALUE_SQL = """v as (select cast(l_linenumber as bigint) as linenumber, cast(round(l_discount * 100) as bigint) as discount,
    cast(round(l_tax * 100) as bigint) as tax, cast(floor(l_extendedprice / 100) as double) as y from lineitem)"""

CLASS_SQL = """c as (select attr, value, label, count(*) as n from (
    select 0 as attr, l_quantity as value, l_returnflag as label from lineitem union all
    select 1, l_discount, l_returnflag from lineitem union all
    select 2, l_tax, l_returnflag from lineitem) group by all)"""

LONG_SQL = """t as (select attr, value, y, count(*) as n from (
    select 0 as attr, linenumber as value, y from v union all select 1, discount, y from v union all select 2, tax, y from v) group by all)"""


def epochs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("epoch"))


def sample_tree() -> DecisionTree:
    tree = DecisionTree()
    left, right = tree.split(0, Rule(0, threshold=25.0))
    low, high = tree.split(right, Rule(1, threshold=0.05))
    for node, label in ((0, 30000.0), (left, 18000.0), (right, 52000.0), (low, 50000.0), (high, 54000.0)):
        tree.label(node, label)
    return tree


SAMPLE_CASE = "case when l_quantity < 25 then 18000.0 when l_discount < 0.05 then 50000.0 else 54000.0 end"

# ---- sources --------------------------------------------------------------------------------------------------------


@query("scan_training_data", "select l_orderkey, l_linenumber, l_quantity as f0, l_discount as f1, l_extendedprice as y from lineitem")
def scan_training_data(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("f0"), F.col("l_discount").alias("f1"), F.col("l_extendedprice").alias("y"))


@query("count_rows", "select count(*) as n from lineitem")
def count_all(spark, sf_dir):
    return count_rows(table(spark, sf_dir, "lineitem"))


NUMBERED = "select row_number() over (order by o_orderkey) - 1 as row_id, o_orderkey, o_totalprice from orders"


def numbered_orders(spark, sf_dir) -> DataFrame:
    return number_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"]).select("row_id", "o_orderkey", "o_totalprice")


@query("slice_rows", f"select * from ({NUMBERED}) where row_id between 100 and 149")
def slice_some(spark, sf_dir):
    return slice_rows(numbered_orders(spark, sf_dir), 100, 50)


@query("select_rows", f"select position, row_id, o_orderkey from (select * from (values (0, 7), (1, 3), (2, 3), (3, 1000)) t(position, wanted)) join ({NUMBERED}) on wanted = row_id")
def select_some(spark, sf_dir):
    return select_rows(numbered_orders(spark, sf_dir), [7, 3, 3, 1000]).select(F.col("position").cast("int").alias("position"), "row_id", "o_orderkey")


@query("chunk_indices", "with n as (select count(*) as n from lineitem), s as (select unnest(range(0, n, 700)) as start, n from n) select start, least(700, n - start) as length from s")
def chunks(spark, sf_dir):
    return chunk_indices(count_rows(table(spark, sf_dir, "lineitem")), 700)


@query("csv_round_trip", "select o_orderkey, o_custkey, o_totalprice from orders")
def csv_round_trip(spark, sf_dir):
    path = new_folder(spark, "csv")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").write.option("header", False).csv(path)
    return csv_file(spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double")


@query("fetch_items", f"with r as ({NUMBERED}), s as (select unnest(range(0, (select count(*) from orders), 500)) as start) select start, row_id, o_orderkey from s join r on row_id >= start and row_id < start + 500")
def fetch(spark, sf_dir):
    rows = numbered_orders(spark, sf_dir)
    return fetch_items(chunk_indices(count_rows(rows), 500), rows, 500).select("start", "row_id", "o_orderkey")


@query("random_classification_source")
def random_classification(spark, sf_dir):
    normal = [[NormalParams(m, 1.0) for m in row] for row in ((1, 1, 1), (2, 2, 2), (4, 4, 4))]
    return RandomClassification(samples=200, chunks=2, rounds=3, seed=7, x_distributions=normal, y_distributions=[NormalParams(m, 0.5) for m in (2, 4, 0)]).frame(spark)


@query("random_regression_source")
def random_regression(spark, sf_dir):
    return RandomRegression(samples=200, chunks=2, rounds=3, seed=7, x_distributions=[NormalParams(m, 1.0) for m in (0, 5, 10)]).frame(spark)


# ---- flow -----------------------------------------------------------------------------------------------------------

DAYS = "select cast(ts as date) as epoch, count(*) as length from events group by 1"


@query("index_data", f"select epoch, length, cast(coalesce(sum(length) over (order by epoch rows between unbounded preceding and 1 preceding), 0) as bigint) as start from ({DAYS})")
def index_chunks(spark, sf_dir):
    return flow.index_data(epochs(spark, sf_dir).groupBy("epoch").agg(F.count("*").alias("length")), "epoch")


@query("segment_training_data", "select segment_id, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from (select event_id, (row_number() over (order by event_id) - 1) // 300 as segment_id from events) group by 1")
def segment(spark, sf_dir):
    rows = number_rows(table(spark, sf_dir, "events").select("event_id"), ["event_id"])
    return flow.segment_training_data(rows, 300).groupBy("segment_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("init_each_time", "select epoch, k from (select distinct cast(ts as date) as epoch from events), (values (1), (2), (3)) t(k)")
def init_each(spark, sf_dir):
    return flow.init_each_time(epochs(spark, sf_dir), spark.createDataFrame([(1,), (2,), (3,)], "k int"))


@query("combine_each_time", """select epoch, coalesce(a, 0) as purchases, coalesce(b, 0) as users from
    (select cast(ts as date) as epoch, count(*) as a from events where event_type = 'purchase' group by 1)
    full join (select cast(ts as date) as epoch, count(distinct user_id) as b from events group by 1) using (epoch)""")  # fmt: skip
def combine(spark, sf_dir):
    rows = epochs(spark, sf_dir)
    a = rows.where("event_type = 'purchase'").groupBy("epoch").agg(F.count("*").alias("a"))
    b = rows.groupBy("epoch").agg(F.countDistinct("user_id").alias("b"))
    return flow.zip_each_time(a, b).select("epoch", F.coalesce("a", F.lit(0)).alias("purchases"), F.coalesce("b", F.lit(0)).alias("users"))


@query("combine_each_time_cogroup", "select cast(ts as date) as epoch, count(*) filter (event_type = 'click') as a, count(*) filter (event_type <> 'click') as b from events group by 1")
def combine_cogroup(spark, sf_dir):
    import pandas as pd

    rows = epochs(spark, sf_dir).select("epoch", "event_type")

    def both(a, b):
        return pd.DataFrame({"epoch": [(a if len(a) else b)["epoch"].iloc[0]], "a": [len(a)], "b": [len(b)]})

    return flow.combine_each_time(rows.where("event_type = 'click'"), rows.where("event_type <> 'click'"), both, "epoch date, a bigint, b bigint")


@query("apply_latest_asof", """with m as (select distinct cast(ts as date) as version from events where extract(day from ts) % 7 = 3),
    e as (select distinct cast(ts as date) as epoch from events),
    p as (select epoch, coalesce(max(version) filter (version <= epoch), min(version)) as version from e, m group by epoch)
    select event_id, epoch, version, value * extract(day from version) as scaled from (select event_id, value, cast(ts as date) as epoch from events) join p using (epoch)""")  # fmt: skip
def latest(spark, sf_dir):
    rows = epochs(spark, sf_dir)
    models = rows.where("day(epoch) % 7 = 3").select(F.col("epoch").alias("version")).distinct().withColumn("factor", F.dayofmonth("version"))
    return flow.apply_latest(models, rows).select("event_id", "epoch", "version", (F.col("value") * F.col("factor")).alias("scaled"))


@query("extract_by_time", "select cast(ts as date) as epoch, string_agg(event_id, ',' order by event_id) as items from events group by 1")
def extract(spark, sf_dir):
    return flow.extract_by_time(epochs(spark, sf_dir), "event_id").select("epoch", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("count_each_time", "select cast(ts as date) as epoch, count(*) as n from events group by 1")
def count_each(spark, sf_dir):
    return flow.count_each_time(epochs(spark, sf_dir))


@query("exchange_evenly", "select count(*) as n, cast(sum(l_orderkey) as bigint) as keys from lineitem")
def evenly(spark, sf_dir):
    return flow.exchange_evenly(table(spark, sf_dir, "lineitem").select("l_orderkey"), 8).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("concat_branch", "select event_type = 'click' as is_click, count(*) as n from events group by 1")
def concat_branch(spark, sf_dir):
    other, clicks = flow.branch(epochs(spark, sf_dir).select("event_type"), F.col("event_type") == "click")
    both = flow.concat(other.withColumn("is_click", F.lit(False)), clicks.withColumn("is_click", F.lit(True)))
    return both.groupBy("is_click").agg(F.count("*").alias("n"))


# ---- quantizers and error measures ----------------------------------------------------------------------------------

UNIFORM, NORMAL = UniformQuantizer(0.0, 0.1, 10), NormalQuantizer(50000.0, 25000.0, 20)


def _buckets(column: str, thresholds: list[float], op: str) -> str:
    parts = " + ".join(f"cast({t!r}::double {op} {column} as bigint)" for t in thresholds)
    return f"select bucket, count(*) as n from (select {parts} as bucket from lineitem) group by 1"


@query("quantize_uniform", _buckets("l_discount", UNIFORM.thresholds(), "<="))
def quantize_uniform(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(UNIFORM.quantize("l_discount").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("quantize_normal", _buckets("l_extendedprice", NORMAL.thresholds(), "<"))
def quantize_normal(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(NORMAL.quantize("l_extendedprice").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def predicted(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_linestatus", "l_returnflag", F.col("l_shipdate").cast("date").alias("epoch"))
    return sample_tree().predict(rows, ["l_quantity", "l_discount"])


def _error(sql: str) -> str:
    return f"select round({sql}, 4) as error from (select *, {SAMPLE_CASE} as p from lineitem)"


@query("metric_mae", _error("avg(abs(l_extendedprice - p))"))
def metric_mae(spark, sf_dir):
    return predicted(spark, sf_dir).agg(F.round(mae(F.col("prediction"), F.col("l_extendedprice")), 4).alias("error"))


@query("metric_rmse", _error("sqrt(avg((l_extendedprice - p) * (l_extendedprice - p)))"))
def metric_rmse(spark, sf_dir):
    return predicted(spark, sf_dir).agg(F.round(rmse(F.col("prediction"), F.col("l_extendedprice")), 4).alias("error"))


@query("metric_incorrect_ratio", "select round(avg(cast(case when l_quantity < 25 then 'A' else 'N' end <> l_returnflag as int)), 9) as error from lineitem")
def metric_incorrect(spark, sf_dir):
    guess = F.when(F.col("l_quantity") < 25, "A").otherwise("N")
    return table(spark, sf_dir, "lineitem").agg(F.round(incorrect_ratio(guess, F.col("l_returnflag")), 9).alias("error"))


@query("prediction_error_by_epoch", f"select epoch, round(avg(abs(l_extendedprice - p)), 8) as error, count(*) as n from (select cast(l_shipdate as date) as epoch, l_extendedprice, {SAMPLE_CASE} as p from lineitem) group by 1")
def error_by_epoch(spark, sf_dir):
    return prediction_error(predicted(spark, sf_dir), mae, "prediction", "l_extendedprice", ["epoch"]).withColumn("error", F.round("error", 8))


# ---- trees ----------------------------------------------------------------------------------------------------------


@query("tree_descend", "select path, count(*) as n from (select case when l_quantity < 25 then '0,1' when l_discount < 0.05 then '0,2,3' else '0,2,4' end as path from lineitem) group by 1")
def tree_descend(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount")
    routed = sample_tree().assign_nodes(rows, ["l_quantity", "l_discount"], path="path")
    return routed.groupBy(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path")).agg(F.count("*").alias("n"))


@query("tree_predict_threshold", f"select l_orderkey, l_linenumber, cast({SAMPLE_CASE} as double) as prediction from lineitem")
def tree_predict_threshold(spark, sf_dir):
    return predicted(spark, sf_dir).select("l_orderkey", "l_linenumber", "prediction")


@query("tree_predict_subset", "select l_orderkey, l_linenumber, case when l_linenumber in (1, 3, 5) then 10.0::double else 20.0::double end as prediction from lineitem")
def tree_predict_subset(spark, sf_dir):
    tree = DecisionTree()
    left, right = tree.split(0, Rule(0, subset=(1, 3, 5)))
    tree.label(left, 10.0)
    tree.label(right, 20.0)
    return tree.predict(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_linenumber"])


@query("tree_leaf_counts", "select leaf, count(*) as n from (select case when l_quantity < 25 then 1 when l_discount < 0.05 then 3 else 4 end as leaf from lineitem) group by 1")
def tree_leaf_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount")
    return rows.groupBy(sample_tree().leaf_column(["l_quantity", "l_discount"]).alias("leaf")).agg(F.count("*").alias("n"))


@query("tree_nodes", "select * from (values (0, false, 0, 25.0::double, 30000.0::double), (1, true, null, null, 18000.0), (2, false, 1, 0.05, 52000.0), (3, true, null, null, 50000.0), (4, true, null, null, 54000.0)) t(node_id, is_leaf, feature, threshold, label)")
def tree_nodes(spark, sf_dir):
    return sample_tree().nodes_frame(spark).select("node_id", "is_leaf", "feature", "threshold", "label")


# ---- classification -------------------------------------------------------------------------------------------------


@query("feature_histogram_exact", f"with {CLASS_SQL} select 0 as node_id, attr, label, cast(value as double) as value, n from c")
def feature_histogram_exact(spark, sf_dir):
    return histograms.feature_histogram_exact(class_rows(spark, sf_dir), CLASS_FEATURES, "label")


@query("histogram_count", f"with {CLASS_SQL} select attr, label, cast(sum(n) as bigint) as n from c group by 1, 2")
def histogram_count(spark, sf_dir):
    return feature_histogram_exact(spark, sf_dir).groupBy("attr", "label").agg(F.sum("n").alias("n"))


@query("histogram_sum_exact", f"with {CLASS_SQL} select attr, label, cast(sum(n) as bigint) as n from c where value <= 0.05 or attr = 0 and value <= 17 group by 1, 2")
def histogram_sum_exact(spark, sf_dir):
    rows = feature_histogram_exact(spark, sf_dir).where("value <= 0.05 or attr = 0 and value <= 17")
    return rows.groupBy("attr", "label").agg(F.sum("n").alias("n"))


@query("candidate_splits_exact", f"with {CLASS_SQL} select distinct attr, cast(value as double) as threshold from c where value > (select min(d.value) from c d where d.attr = c.attr)")
def candidate_splits_exact(spark, sf_dir):
    values = feature_histogram_exact(spark, sf_dir).select("attr", "value").distinct()
    least = values.groupBy("attr").agg(F.min("value").alias("least"))
    return values.join(least, "attr").where("value > least").select("attr", F.col("value").alias("threshold"))


@query("feature_histogram_approx")
def feature_histogram_approx(spark, sf_dir):
    return histograms.feature_histogram(class_rows(spark, sf_dir), CLASS_FEATURES, "label", 20)


@query("histogram_merge_approx")
def histogram_merge_approx(spark, sf_dir):
    """Merged over labels: the same aggregate at a coarser key."""
    long = histograms.unpivot(class_rows(spark, sf_dir), CLASS_FEATURES, ["node_id"])
    return long.groupBy("node_id", "attr").agg(histograms.fuse_equal(F.histogram_numeric("value", F.lit(20))).alias("bins"))


def _gini_sql(right: str) -> str:
    return f"""with {CLASS_SQL}, tot as (select attr, label, sum(n) as c from c group by 1, 2),
    g as (select v.attr, v.value as threshold, tot.label, tot.c, coalesce((select sum(n) from c where c.attr = v.attr and c.label = tot.label and c.value < v.value), 0) as s
        from (select distinct attr, value from c) v join tot on v.attr = tot.attr),
    k as (select attr, threshold, cast(sum(c) as double) as n, cast(sum(s) as double) as l, sum(c::double * c) as cc, sum(s::double * s) as ss, sum((c - s)::double * (c - s)) as rr, count(*) as k from g group by 1, 2)
    select attr, cast(threshold as double) as threshold, cast(l as bigint) as n_left, cast(n as bigint) as n,
        1 - cc / (n * n) - l / n * (1 - ss / (l * l)) - (1 - l / n) * (1 - ({right})) as gain
    from k where l > 0 and l < n"""


GINI_SQL = _gini_sql("rr / ((n - l) * (n - l))")


@query("gini_by_split", f"select attr, threshold, n_left, n, round(gain, 9) as gain from ({GINI_SQL})")
def gini(spark, sf_dir):
    return splits.gini_by_split(feature_histogram_exact(spark, sf_dir)).select("attr", "threshold", "n_left", "n", F.round("gain", 9).alias("gain"))


@query("gini_parity_by_split", f"select attr, threshold, n_left, n, round(gain, 9) as gain from ({_gini_sql('k - 2 + ss / (l * l)')})")
def gini_parity(spark, sf_dir):
    return splits.gini_by_split(feature_histogram_exact(spark, sf_dir), parity=True).select("attr", "threshold", "n_left", "n", F.round("gain", 9).alias("gain"))


BEST_SQL = f"select attr, threshold from ({GINI_SQL}) order by round(gain, 9) desc, attr, threshold limit 1"


@query("best_split_per_leaf", f"select 0 as node_id, * from ({BEST_SQL})")
def best_split(spark, sf_dir):
    return splits.best_split(splits.gini_by_split(feature_histogram_exact(spark, sf_dir))).select("node_id", "attr", "threshold")


@query("node_majority_label", "select 0 as node_id, l_returnflag as label, count(*) as n from lineitem group by 2 order by n desc, label limit 1")
def majority(spark, sf_dir):
    return splits.majority_label(class_rows(spark, sf_dir).groupBy("node_id", "label").agg(F.count("*").alias("n")))


CTREE_SQL = f"""with b as ({BEST_SQL}), r as (select *, case when (case (select attr from b) when 0 then l_quantity when 1 then l_discount else l_tax end) < (select threshold from b) then 1 else 2 end as leaf from lineitem),
    m as (select leaf, min(l_returnflag) as label from (select leaf, l_returnflag, count(*) as n, max(count(*)) over (partition by leaf) as top from r group by 1, 2) where n = top group by 1)"""


@query("ctree_predict", f"{CTREE_SQL} select l_orderkey, l_linenumber, m.label as prediction from r join m using (leaf)")
def ctree_predict(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    model = StreamingClassificationTree(levels=1).fit(rows, CLASS_FEATURES, "l_returnflag")
    return model.transform(rows.select("l_orderkey", "l_linenumber", *CLASS_FEATURES)).select("l_orderkey", "l_linenumber", "prediction")


@query("ctree_incorrect_ratio", f"{CTREE_SQL} select round(avg(cast(m.label <> l_returnflag as int)), 9) as error from r join m using (leaf)")
def ctree_incorrect(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    model = StreamingClassificationTree(levels=1).fit(rows, CLASS_FEATURES, "l_returnflag")
    return model.transform(rows.select(*CLASS_FEATURES, "l_returnflag")).agg(F.round(incorrect_ratio(F.col("prediction"), F.col("l_returnflag")), 9).alias("error"))


@query("ctree_train_nodes", classification_nodes(3, CLASS_FEATURES, "l_returnflag", "lineitem"))
def ctree_nodes(spark, sf_dir):
    tree = StreamingClassificationTree(levels=3).fit(table(spark, sf_dir, "lineitem"), CLASS_FEATURES, "l_returnflag").tree
    return tree.nodes_frame(spark, "string").select("node_id", "is_leaf", "feature", "threshold", "label")


@query("ctree_bounded_nodes")
def ctree_bounded(spark, sf_dir):
    wide = table(spark, sf_dir, "embeddings").select(*(F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(64)), "label")
    return StreamingClassificationTree(levels=3, bins=16).fit(wide, [f"f{i}" for i in range(64)], "label").tree.nodes_frame(spark, "int")


# ---- regression and boosting ----------------------------------------------------------------------------------------


def exact_targets(spark, sf_dir) -> DataFrame:
    return histograms.target_histogram_exact(value_rows(spark, sf_dir), VALUE_FEATURES, "y")


@query("target_histogram_exact", f"with {VALUE_SQL}, {LONG_SQL} select attr, value, y, n from t")
def target_histogram_exact(spark, sf_dir):
    return exact_targets(spark, sf_dir).select("attr", "value", "y", "n")


@query("target_histogram_approx")
def target_histogram_approx(spark, sf_dir):
    return histograms.target_histogram(value_rows(spark, sf_dir).select("linenumber", "y"), ["linenumber"], 20)


MEDIAN = "list_sort(list(y))[cast(floor(count(*) / 2) as int) + 1]"


@query("target_median", f"with {VALUE_SQL} select linenumber, {MEDIAN} as median from v group by 1")
def target_median(spark, sf_dir):
    counts = value_rows(spark, sf_dir).groupBy("linenumber", "y").agg(F.count("*").alias("n"))
    return histograms.weighted_upper_median(counts, ["linenumber"])


@query("trimmed_lad", f"""with {VALUE_SQL}, r as (select linenumber, y, row_number() over (partition by linenumber order by y) - 1 as rank, count(*) over (partition by linenumber) as n from v),
    m as (select linenumber, {MEDIAN} as median from v group by 1)
    select linenumber, n, median, round(sum(abs(y - median)), 4) as loss from r join m using (linenumber)
    where rank >= floor(0.1 / 2 * n + 0.5) and rank < n - floor(0.1 / 2 * n + 0.5) group by 1, 2, 3""")  # fmt: skip
def trimmed(spark, sf_dir):
    counts = value_rows(spark, sf_dir).groupBy("linenumber", "y").agg(F.count("*").alias("n"))
    return splits.trimmed_lad(counts, ["linenumber"], 0.9).withColumn("loss", F.round("loss", 4))


CUTS_SQL = f"""{VALUE_SQL}, {LONG_SQL},
    x as (select attr, value, y from t, range(n)),
    o as (select attr, value, row_number() over (partition by attr order by {MEDIAN}, value) as place from x group by 1, 2),
    k as (select a.attr, a.place as cut from o a where a.place < (select max(place) from o where attr = a.attr)),
    s as (select x.attr, k.cut, o.place <= k.cut as l, x.y from x join o using (attr, value) join k on k.attr = x.attr),
    w as (select attr, cut, l, count(*) as n, {MEDIAN} as median from s group by 1, 2, 3),
    d as (select s.attr, s.cut, s.l, w.n, sum(abs(s.y - w.median)) as loss from s join w on s.attr = w.attr and s.cut = w.cut and s.l = w.l group by 1, 2, 3, 4),
    c as (select attr, cut, cast(sum(n) as bigint) as n, sum(loss * n) / sum(n) as loss from d group by 1, 2)"""


@query("weighted_loss", f"with {CUTS_SQL} select attr, cast(cut as int) as cut, n, round(loss, 4) as loss from c")
def weighted(spark, sf_dir):
    return splits.subset_losses(exact_targets(spark, sf_dir)).select("attr", "cut", "n", F.round("loss", 4).alias("loss"))


BEST_CUT = "select attr, cut from c order by round(loss, 9), attr, cut limit 1"


@query("rtree_best_split", f"with {CUTS_SQL}, b as ({BEST_CUT}) select 0 as node_id, attr, cast(cut as int) as cut, (select string_agg(value, ',' order by value) from o where o.attr = b.attr and o.place <= b.cut) as subset from b")
def rtree_best(spark, sf_dir):
    best = splits.best_subset(splits.subset_losses(exact_targets(spark, sf_dir)))
    return best.select("node_id", "attr", "cut", F.array_join(F.transform("subset", lambda x: x.cast("string")), ",").alias("subset"))


RTREE_SQL = f"""with {CUTS_SQL}, b as ({BEST_CUT}), chosen as (select value from o join b on o.attr = b.attr and o.place <= b.cut),
    p as (select *, (case (select attr from b) when 0 then linenumber when 1 then discount else tax end) in (select value from chosen) as l from v),
    h as (select l, {MEDIAN} as median from p group by 1)"""


@query("rtree_mae", f"{RTREE_SQL} select round(avg(abs(y - median)), 6) as error from p join h using (l)")
def rtree_mae(spark, sf_dir):
    rows = value_rows(spark, sf_dir)
    model = StreamingRegressionTree(levels=1).fit(rows, VALUE_FEATURES, "y")
    return model.transform(rows).agg(F.round(mae(F.col("prediction"), F.col("y")), 6).alias("error"))


@query("rtree_predict", f"{RTREE_SQL} select median as prediction, count(*) as n, sum(y) as total from p join h using (l) group by 1")
def rtree_predict(spark, sf_dir):
    rows = value_rows(spark, sf_dir)
    model = StreamingRegressionTree(levels=1).fit(rows, VALUE_FEATURES, "y")
    return model.transform(rows).groupBy("prediction").agg(F.count("*").alias("n"), F.sum("y").alias("total"))


VALUE_COUNTS_SQL = [VALUE_SQL, "counts as (select linenumber as f0, discount as f1, tax as f2, 0.0::double as done, y, count(*) as n from v group by all)"]


@query("rtree_train_nodes", regression_nodes(3, VALUE_COUNTS_SQL, "counts", 3))
def rtree_nodes(spark, sf_dir):
    nodes = StreamingRegressionTree(levels=3).fit(value_rows(spark, sf_dir), VALUE_FEATURES, "y").tree.nodes_frame(spark)
    return nodes.select("node_id", "is_leaf", "feature", F.array_join(F.transform("subset", lambda x: x.cast("string")), ",").alias("subset"), "label")


@query("rtree_bounded_nodes")
def rtree_bounded(spark, sf_dir):
    return StreamingRegressionTree(levels=2, bins=16).fit(value_rows(spark, sf_dir), VALUE_FEATURES, "y").tree.nodes_frame(spark)


@query("gbm_residuals", f"{RTREE_SQL} select round(y - 0.5 * median, 6) as residual, count(*) as n from p join h using (l) group by 1")
def gbm_residuals(spark, sf_dir):
    rows = value_rows(spark, sf_dir)
    chain = GradientBoostingRegression(1, StreamingRegressionTree(levels=1), 0.5).fit(rows, VALUE_FEATURES, "y")
    return chain.transform(rows).groupBy(F.round(F.col("y") - F.col("prediction"), 6).alias("residual")).agg(F.count("*").alias("n"))


@query("gbm_predict_2stage", boosted_counts(2, 0.5, VALUE_COUNTS_SQL, "counts", 3))
def gbm_predict(spark, sf_dir):
    rows = value_rows(spark, sf_dir)
    chain = GradientBoostingRegression(2, StreamingRegressionTree(levels=1), 0.5).fit(rows, VALUE_FEATURES, "y")
    return chain.transform(rows).groupBy("prediction").agg(F.count("*").alias("n"))


@query("gbm_mae")
def gbm_mae(spark, sf_dir):
    rows = value_rows(spark, sf_dir)
    chain = GradientBoostingRegression(5, StreamingRegressionTree(levels=2, bins=32), 0.3).fit(rows, VALUE_FEATURES, "y")
    return chain.transform(rows).agg(F.round(mae(F.col("prediction"), F.col("y")), 6).alias("error"))


# ---- k-means --------------------------------------------------------------------------------------------------------

START = [[5.0, 2.0, 1.0], [18.0, 7.0, 3.0], [33.0, 1.0, 6.0], [47.0, 9.0, 8.0]]


def points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.array(F.col("l_quantity").cast("double"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)).alias("features"),
    )


POINTS_SQL = "p as (select row_number() over () as rid, l_orderkey * 10 + l_linenumber as row_id, l_quantity::double as x, round(l_discount * 100) as y, round(l_tax * 100) as z from lineitem)"
START_SQL = "c0 as (select * from (values " + ", ".join(f"({k}, {c[0]}::double, {c[1]}::double, {c[2]}::double)" for k, c in enumerate(START)) + ") t(cluster, cx, cy, cz))"


def _assign_sql(c: str) -> str:
    return f"select row_id, x, y, z, arg_min(cluster, struct_pack(d := (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz), k := cluster)) as cluster from p, {c} group by rid, row_id, x, y, z"


def _lloyd_sql(n: int) -> str:
    """n updates after the start, as common table expressions a1, c1, ..."""
    out = [POINTS_SQL, START_SQL]
    for i in range(1, n + 1):
        out.append(f"a{i} as ({_assign_sql(f'c{i - 1}')})")
        out.append(f"c{i} as (select c0.cluster, coalesce(avg(x), 0) as cx, coalesce(avg(y), 0) as cy, coalesce(avg(z), 0) as cz from c0 left join a{i} on a{i}.cluster = c0.cluster group by 1)")
    return "with " + ", ".join(out)


def flat_centroids(spark, centroids) -> DataFrame:
    return spark.createDataFrame([(k, *(round(v, 6) for v in c)) for k, c in enumerate(centroids)], "cluster int, cx double, cy double, cz double")


ROUNDED = "cluster, round(cx, 6) as cx, round(cy, 6) as cy, round(cz, 6) as cz"


@query("kmeans_assign", f"{_lloyd_sql(1)} select row_id, cluster from a1")
def kmeans_assign(spark, sf_dir):
    return points(spark, sf_dir).select("row_id", nearest("features", START).alias("cluster"))


@query("kmeans_accumulate", f"{_lloyd_sql(1)} select cluster, count(*) as n, sum(x) as sx, sum(y) as sy, sum(z) as sz from a1 group by 1")
def kmeans_accumulate(spark, sf_dir):
    assigned = points(spark, sf_dir).withColumn("cluster", nearest("features", START))
    return accumulate(assigned, 3).select("cluster", "n", *(F.get("sums", F.lit(i)).alias(f"s{c}") for i, c in enumerate("xyz")))


@query("kmeans_centroid_estimate", f"{_lloyd_sql(1)} select {ROUNDED} from c1 union all select 4, 0, 0, 0")
def kmeans_estimate(spark, sf_dir):
    """The fifth cluster is far from all rows: an empty one is the zero vector."""
    assigned = points(spark, sf_dir).withColumn("cluster", nearest("features", [*START, [1e6, 1e6, 1e6]]))
    out = estimate(accumulate(assigned, 3), 5, 3)
    return out.select("cluster", *(F.round(F.get("centroid", F.lit(i)), 6).alias(f"c{c}") for i, c in enumerate("xyz")))


@query("kmeans_converged", f"{_lloyd_sql(2)} select round(sum(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2)), 6) as moved from c1 a join c2 b using (cluster)")
def kmeans_converged(spark, sf_dir):
    one = KMeans(4, 3, ConvergenceCriteria(1)).fit(points(spark, sf_dir), initial=START).centroids
    two = KMeans(4, 3, ConvergenceCriteria(2)).fit(points(spark, sf_dir), initial=START).centroids
    import math

    return spark.createDataFrame([(round(sum(math.dist(a, b) for a, b in zip(one, two, strict=True)), 6),)], "moved double")


@query("kmeans_train_5iter", f"{_lloyd_sql(5)} select {ROUNDED} from c5")
def kmeans_train(spark, sf_dir):
    return flat_centroids(spark, KMeans(4, 3, ConvergenceCriteria(5)).fit(points(spark, sf_dir), initial=START).centroids)


@query("kmeans_predict", f"{_lloyd_sql(3)} select cluster, count(*) as n from ({_assign_sql('c3')}) group by 1")
def kmeans_predict(spark, sf_dir):
    rows = points(spark, sf_dir)
    return KMeans(4, 3, ConvergenceCriteria(3)).fit(rows, initial=START).transform(rows).groupBy("cluster").agg(F.count("*").alias("n"))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda v: v.cast("double")).alias("features"))


def listed_centroids(spark, centroids) -> DataFrame:
    """cluster, dim, value."""
    return spark.createDataFrame([(k, j, v) for k, c in enumerate(centroids) for j, v in enumerate(c)], "cluster int, dim int, value double")


LISTED = "cluster, unnest(range(len(c))) as dim, unnest(c) as value"


@query("kmeans_init_random", f"""with s as (select row_number() over (order by md5(vec_id || ':3'), vec_id) - 1 as cluster, list_transform(embedding, lambda x: x::double) as c from embeddings where embedding is not null)
    select {LISTED} from s where cluster < 10""")  # fmt: skip
def kmeans_init_random(spark, sf_dir):
    return listed_centroids(spark, RandomSample(3).select(vectors(spark, sf_dir), 10, "features", "row_id"))


PLUS_PLUS_SQL = plus_plus_ctes(10, 3, "embeddings", "vec_id", "embedding")


@query("kmeans_init_plusplus", f"with {', '.join(PLUS_PLUS_SQL)} select {LISTED} from start")
def kmeans_init_plusplus(spark, sf_dir):
    return listed_centroids(spark, KMeansPlusPlus(3).select(vectors(spark, sf_dir), 10, "features", "row_id"))


@query("kmeans_embeddings", f"with {', '.join([*PLUS_PLUS_SQL, *lloyd_ctes(10, 64), nearest_cte('last', 'c10')])} select cluster, count(*) as n from last group by 1")
def kmeans_embeddings(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    model = KMeans(10, 64, ConvergenceCriteria(10, 1e-4), KMeansPlusPlus(3)).fit(rows)
    return model.transform(rows).groupBy("cluster").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, quantize, train a regression tree on the quantized features, predict, and measure the error by return flag."""
    q = UniformQuantizer(0.0, 50.0, 10)
    rows = table(spark, sf_dir, "lineitem").select(
        q.quantize("l_quantity").alias("q"), F.round(F.col("l_discount") * 100).cast("bigint").alias("d"), F.col("l_linenumber").cast("bigint").alias("l"),
        F.col("l_extendedprice").alias("y"), "l_returnflag",
    )
    model = StreamingRegressionTree(levels=3, bins=32).fit(rows, ["q", "d", "l"], "y")
    return prediction_error(model.transform(rows), mae, "prediction", "y", ["l_returnflag"])


