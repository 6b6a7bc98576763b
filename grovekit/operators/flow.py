"""Time-aligned operators. A logical time is an epoch column; a micro-batch id plays the same part in streams."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


#: Rows that init_each_time() repeats at each epoch, and broadcasts.
INITIAL_ROWS = 100_000


def init_each_time(trigger: DataFrame, initial: DataFrame, epoch: str = "epoch") -> DataFrame:
    """The rows of initial (INITIAL_ROWS at most) once for each distinct epoch of trigger."""
    if initial.limit(INITIAL_ROWS + 1).count() > INITIAL_ROWS:
        raise ValueError(f"initial has more than {INITIAL_ROWS} rows")
    return trigger.select(epoch).distinct().crossJoin(F.broadcast(initial))


def index_data(chunks: DataFrame, order: str = "chunk_id", length: str = "length") -> DataFrame:
    """start of each chunk: the lengths of all chunks before it, in ranges of their order."""
    return running(chunks, [order], F.col(length), "start", inclusive=False).withColumn("start", F.coalesce("start", F.lit(0)).cast("bigint"))


def segment_training_data(numbered: DataFrame, size: int, row_id: str = "row_id") -> DataFrame:
    """segment_id of size rows each, of rows numbered from 0."""
    if size < 1:
        raise ValueError("size >= 1 is needed")
    return numbered.withColumn("segment_id", F.floor(F.col(row_id) / size).cast("bigint"))


def exchange_evenly(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def concat(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def branch(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which the condition doesn't hold (or is null), and rows for which it does."""
    holds = F.coalesce(condition, F.lit(False))
    return df.where(~holds), df.where(holds)


def partition(df: DataFrame, n: int, route: Column) -> list[DataFrame]:
    return [df.where(route == k) for k in range(n)]


def combine_each_time(a: DataFrame, b: DataFrame, combine: Callable, schema: str, epoch: str = "epoch") -> DataFrame:
    """Full outer cogroup by epoch: combine(pandas frame of a, pandas frame of b) -> pandas frame, also where one is
    empty. For aggregates per epoch use zip_each_time(), which stays in the JVM and gathers nothing."""
    return a.groupBy(epoch).cogroup(b.groupBy(epoch)).applyInPandas(combine, schema)


def zip_each_time(a: DataFrame, b: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Full outer join by epoch of two frames with a row for each epoch."""
    return a.join(b, epoch, "full_outer")


def apply_latest(models: DataFrame, inputs: DataFrame, version: str = "version", epoch: str = "epoch") -> DataFrame:
    """Each input row with the model of the greatest version <= its epoch; inputs before the first model get the first.

    models has a row a version. Epochs and versions are put in one order, in which a running maximum tells the version of
    each epoch; the match is found once for each epoch and joined back by equality.
    """
    marks = inputs.select(F.col(epoch).alias("_at")).distinct().withColumn("_v", F.lit(None)).unionByName(
        models.select(F.col(version).alias("_at")).distinct().withColumn("_v", F.col("_at"))
    )
    marks = marks.groupBy("_at").agg(F.max("_v").alias("_v"))  # a version at an epoch counts for it
    first = models.agg(F.min(version)).first()[0]
    pick = running(marks, ["_at"], F.col("_v"), "_latest", "max").select(F.col("_at").alias(epoch), F.coalesce("_latest", F.lit(first)).alias("_v"))
    return inputs.join(pick, epoch).join(models.withColumnRenamed(version, "_m"), F.col("_v") == F.col("_m")).drop("_m").withColumnRenamed("_v", version)


def extract_by_time(df: DataFrame, value: str, epoch: str = "epoch") -> DataFrame:
    """The items of each epoch as a sorted array."""
    return df.groupBy(epoch).agg(F.sort_array(F.collect_list(value)).alias("items"))


def count_each_time(df: DataFrame, epoch: str = "epoch") -> DataFrame:
    return df.groupBy(epoch).agg(F.count("*").alias("n"))


def inspect(df: DataFrame, show: Callable[[DataFrame], object], epoch: str | None = None) -> DataFrame:
    """Calls show on the rows and hands them on; with epoch, on the rows of each epoch in order. For tables that are small
    or whose epochs are few; observe() costs no pass of its own."""
    for value in [None] if epoch is None else [r[0] for r in df.select(epoch).distinct().orderBy(epoch).toLocalIterator()]:
        show(df if epoch is None else df.where(F.col(epoch).eqNullSafe(F.lit(value))))
    return df


def observe(df: DataFrame, name: str, **measures: Column):
    """df and an Observation, which has the measures of its rows once an action has run over it."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in measures.items())), seen


def time_each_epoch(df: DataFrame, action: Callable[[DataFrame], object], epoch: str = "epoch") -> list[tuple]:
    """Epoch, result and seconds of an action on the rows of each epoch, in order."""
    values = [r[0] for r in df.select(epoch).distinct().orderBy(epoch).toLocalIterator()]
    return [(v, *timed(lambda v=v: action(df.where(F.col(epoch).eqNullSafe(F.lit(v)))))) for v in values]


def timed(action: Callable):
    """The action's result and the seconds that it took."""
    began = time.perf_counter()
    out = action()
    return out, time.perf_counter() - began


def latest_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """A bounded cache: the n latest rows."""
    return df.orderBy(F.desc(order)).limit(n)
