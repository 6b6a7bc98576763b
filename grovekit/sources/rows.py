"""Row numbers, slices, chunks and selections of tables that have an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running


def number_rows(df: DataFrame, order: list[str | Column], name: str = "row_id") -> DataFrame:
    """Numbers rows from 0 in a total order, without gathering them: ranges of the order are numbered each by itself and
    shifted by the sizes of the ranges before, of which there is one a partition. The order must have no ties."""
    return running(df, order, F.lit(1).cast("bigint"), name, inclusive=False).withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def slice_rows(df: DataFrame, start: int, length: int, row_id: str = "row_id") -> DataFrame:
    """Rows [start, start + length) by row number; what is beyond the end is left out."""
    return df.where(F.col(row_id).between(start, start + length - 1))


def select_rows(df: DataFrame, indices: list[int], row_id: str = "row_id") -> DataFrame:
    """Rows by number, in any order and with repetitions; position tells the place in indices."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(indices)), "position bigint, _row bigint")
    return df.join(F.broadcast(wanted), F.col(row_id) == F.col("_row")).drop("_row")


def chunk_indices(n_rows: DataFrame, size: int, column: str = "n") -> DataFrame:
    """start and length of each chunk of size rows; the last one is short."""
    if size < 1:
        raise ValueError("size >= 1 is needed")
    n = F.col(column)
    starts = n_rows.where(n > 0).select(n, F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(size).cast("bigint"))).alias("start"))
    return starts.select("start", F.least(F.lit(size).cast("bigint"), n - F.col("start")).alias("length"))


def array_source(spark: SparkSession, rows: list[list], schema: str = "row_id bigint, features array<double>") -> DataFrame:
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], schema)


def fetch_items(slices: DataFrame, rows: DataFrame, size: int, epoch: str = "epoch", row_id: str = "row_id") -> DataFrame:
    """Rows of each (epoch, start, length): a range join on buckets of size rows, so that it is an equality join first.

    A slice is repeated for the buckets it touches; size is the usual length of a slice.
    """
    s = slices.where("length > 0").withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("length") - 1) / size)))
    )
    r = rows.withColumn("_bucket", F.floor(F.col(row_id) / size))
    keys = ["_bucket", epoch] if epoch in rows.columns else ["_bucket"]
    return s.join(r, keys).where((F.col(row_id) >= F.col("start")) & (F.col(row_id) < F.col("start") + F.col("length"))).drop("_bucket")
