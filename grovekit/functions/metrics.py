"""Error measures as aggregate columns. Truth and prediction stand in one row; rows with a null in either don't count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Takes prediction and truth.
ErrorMeasure = Callable[[Column, Column], Column]


def mae(prediction: Column, truth: Column) -> Column:
    return F.avg(F.abs(truth - prediction))


def rmse(prediction: Column, truth: Column) -> Column:
    return F.sqrt(F.avg((truth - prediction) * (truth - prediction)))


def incorrect_ratio(prediction: Column, truth: Column) -> Column:
    return F.avg((prediction != truth).cast("int"))


def prediction_error(df: DataFrame, measure: ErrorMeasure, prediction: str, truth: str, by: list[str] | None = None) -> DataFrame:
    """The error of each group (epoch, chunk), or of all rows."""
    return df.groupBy(*(by or [])).agg(measure(F.col(prediction), F.col(truth)).alias("error"), F.count("*").alias("n"))


def zip_predictions(predictions: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """For predictions that come apart from their truth: both sides joined on a position such as (epoch, chunk, row)."""
    return predictions.join(truth, keys)
