"""Cutting long lineages in the shared folder of the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..scratch import write_table


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to spark.checkpoint.dir (else the warehouse) and read again; survives lost executors."""
    return write_table(df, "lineage")
