"""Connected components of an edge table, without collecting it: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """id, component: for each end of an edge (a, b) the least id that it reaches.

    A round takes the least label among neighbours (partial aggregation keeps hot ends cheap) and then the label's own
    label, so long chains halve. Each round is a written table: a lost executor costs one round at most.
    """
    both = write_table(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{label}-edges"
    )
    labels = write_table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{label}-0")
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("seen"))
        )
        least = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "seen").alias("now"))
        least = write_table(least, f"{label}-near")
        jump = least.select(F.col("id").alias("now"), F.col("now").alias("further"))
        after = write_table(
            least.join(jump, "now", "left").select("id", F.least("now", F.coalesce("further", "now")).alias("component"), "was"),
            f"{label}-round",
        )
        changed = after.where("component <> was").limit(1).count()
        drop_table(least, labels)
        labels = after.drop("was")
        labels.scratch_path = after.scratch_path
        if not changed:
            drop_table(both)
            return labels
