"""CSV sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv_file(spark: SparkSession, path: str, schema: str | StructType, header: bool = False, sep: str = ",", strict: bool = True) -> DataFrame:
    """strict: a bad cell fails the read; else its row has nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path, header=header, sep=sep)


def csv_strings(lines: DataFrame, schema: str, column: str = "value", header: bool = False, sep: str = ",") -> DataFrame:
    """CSV text, a line a row; a header is a line equal to the column names."""
    options = {"sep": sep, "mode": "FAILFAST"}
    names = sep.join(StructType.fromDDL(schema).names)
    rows = lines.where(F.col(column) != names) if header else lines
    return rows.select(F.from_csv(column, schema, options).alias("r")).select("r.*")


def training_data_from_csv(spark: SparkSession, path: str, n_features: int, kind: str = "double", streaming: bool = False) -> DataFrame:
    """features and target of x0..xn-1,y lines: the target is the last column, and there is no header."""
    schema = ", ".join([*(f"x{i} {kind}" for i in range(n_features)), "y double"])
    reader = (spark.readStream if streaming else spark.read).schema(schema).option("mode", "FAILFAST").option("header", False)
    return reader.csv(path).select(F.array(*(f"x{i}" for i in range(n_features))).alias("features"), F.col("y").alias("target"))


def flat_samples(df: DataFrame, n_features: int, features: str = "features", target: str = "target") -> DataFrame:
    return df.select(*(F.get(features, F.lit(i)).alias(f"x{i}") for i in range(n_features)), F.col(target).alias("y"))


def training_data_to_csv(df: DataFrame, path: str, n_features: int, features: str = "features", target: str = "target", mode: str = "error") -> None:
    flat_samples(df, n_features, features, target).write.mode(mode).option("header", False).csv(path)


def dump_predictions(df: DataFrame, path: str, prediction: str = "prediction", truth: str = "target") -> None:
    df.select(prediction, truth).write.mode("overwrite").option("header", False).csv(path)
