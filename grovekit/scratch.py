"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: dict[str, tuple[SparkSession, list[str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the warehouse. A warehouse on the driver's own disk is refused on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    base = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and (base.startswith("file:") or "://" not in base):
        raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of one machine")
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_folder(spark: SparkSession, label: str) -> str:
    """A path that is free, in the folder of this application; release() deletes it."""
    app = spark.sparkContext.applicationId
    _, paths = _open.setdefault(app, (spark, []))
    paths.append(f"{shared_dir(spark)}/grovekit-scratch/{app}/{label}-{uuid.uuid4().hex}")
    return paths[-1]


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back. Survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Deletes tables of write_table() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path:
            _delete(t.sparkSession, path)
            paths = _open[t.sparkSession.sparkContext.applicationId][1]
            if path in paths:
                paths.remove(path)


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes, when its block ends, all tables written within, but for those that are put into the list that it gives."""
    app = spark.sparkContext.applicationId
    before = set(_open.setdefault(app, (spark, []))[1])
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        stay = before | {getattr(t, "scratch_path", None) for t in kept}
        paths = _open[app][1]
        for path in [p for p in paths if p not in stay]:
            _delete(spark, path)
            paths.remove(path)


def release(spark: SparkSession) -> None:
    """Deletes the folder of this application. Results that still read it are to be written before."""
    _open.pop(spark.sparkContext.applicationId, None)
    _delete(spark, f"{shared_dir(spark)}/grovekit-scratch/{spark.sparkContext.applicationId}")


@atexit.register
def _release_all() -> None:
    """At the driver's end, for applications that still run; stopped ones are past results, and so are their folders."""
    for spark, paths in list(_open.values()):
        for path in paths[:1]:
            try:
                _delete(spark, path.rsplit("/", 1)[0])
            except Exception:  # the gateway has gone: the folder bears the application's id and can be deleted by it
                return
