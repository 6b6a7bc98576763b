"""Running sums and maxima over a whole table's order without one task for all of it: ranges of the order run each by
themselves and are carried on from the ranges before, of which there is one a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import write_table


def running(df: DataFrame, order: list[str | Column], value: Column, name: str, how: str = "sum", inclusive: bool = True) -> DataFrame:
    """df with the sum or max of value over all rows up to this one in the order. Rows up to here: with it if inclusive. The
    order must have no ties. The ranges are written, so that a lost executor doesn't deal them anew."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    spark, n = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    aggregate = {"sum": F.sum, "max": F.max}[how]
    ranged = write_table(df.withColumn("_value", value).repartitionByRange(n, *columns).withColumn("_range", F.spark_partition_id()), "ranged")
    parts = sorted(ranged.groupBy("_range").agg(aggregate("_value").alias("v")).collect())  # a row a partition
    carries, carry = [], None
    for part in parts:
        carries.append((part["_range"], carry))
        if part["v"] is not None:
            carry = part["v"] if carry is None else carry + part["v"] if how == "sum" else max(carry, part["v"])
    kind = ranged.select(aggregate("_value").alias("v")).schema["v"].dataType.simpleString()
    before = spark.createDataFrame(carries, f"_range int, _carry {kind}")
    inside = aggregate("_value").over(W.partitionBy("_range").orderBy(*columns).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
    total = F.coalesce(F.col("_inside") + F.col("_carry"), "_inside", "_carry") if how == "sum" else F.greatest("_inside", "_carry")
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, total).drop("_value", "_range", "_inside", "_carry")
