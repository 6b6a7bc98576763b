"""Exact deduplication over a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is hashed once, reduced to one row per digest by partial
aggregation, held against the index by a sort-merge anti-join, and what is new is appended. Each row tells its batch: rows of
the same batch don't count as known, so that a batch that is tried again gets the same answer and is appended once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_folder, shared_dir
from .common import UPPER, write_table

#: A digest with at least this share of the batch's rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def normalised(text: Column) -> Column:
    """Texts are equal when identical after lower-casing A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


@dataclass
class Batch:
    """rows: a batch's result; commit() appends its digests to the index, once, however often it is called."""

    rows: DataFrame
    batch_id: str
    commit: Callable[[], None]


class DigestIndex:
    """Two bucketed, sorted tables: digests with the row that stays (name), and later batches' rows of known digests
    (name_again). A named index lies in the shared folder and is found again by later sessions; one without a name ends
    with the application."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        base = f"{shared_dir(spark)}/grovekit-index/{name}" if name else new_folder(spark, "digest-index")
        self.buckets = self._buckets(base) or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.base = f"{base}/buckets={self.buckets}"
        for table, columns in ((self.name, "digest binary, keep_id bigint, n bigint, batch string"), (f"{self.name}_again", "digest binary, n bigint, batch string")):
            spark.sql(
                f"create table if not exists {table} ({columns}) using parquet clustered by (digest) sorted by (digest)"
                f" into {self.buckets} buckets location '{self.base}/{table}'"
            )

    def _folder(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _buckets(self, base: str) -> int | None:
        """The number of buckets that an index in this folder has."""
        path, fs = self._folder(base)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return next((int(n.split("=")[1]) for n in sorted(names) if n.startswith("buckets=")), None)

    def drop(self) -> None:
        for table in (self.name, f"{self.name}_again"):
            self.spark.sql(f"drop table if exists {table}")
        path, fs = self._folder(self.base.rsplit("/", 1)[0])
        fs.delete(path, True)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def dedup(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batch_id: str | None = None, alone: bool = False) -> Batch:
        """Deduplicates docs against the index and within itself; the index doesn't change before commit().

        The result has a row for each input row: doc_id, keep_id, group_size, kept, text_sha256. Within a batch the
        largest doc_id of a digest stays; a digest that an earlier batch brought keeps that batch's row, and group_size
        counts the rows of all batches up to this one. Without batch_id the rows' own hash tells the batch. alone: the
        index is to hold this batch only and forgets others. Null texts count as empty. A null doc_id stays only if its
        whole group has none. Of rows that repeat both id and text one is kept. An empty table gives no rows. Other
        columns are not read.
        """
        batch = write_table(
            docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"))
            .groupBy("doc_id", "digest")
            .agg(F.count("*").alias("m")),
            "digests",
        )
        found = batch.agg(F.sum("m").alias("rows"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id", "digest", "m")).alias("x")).first()
        total, me = found["rows"] or 0, batch_id or f"{found['rows'] or 0}-{found['n']}-{found['x'] or 0}"
        if alone and self.table().where(F.col("batch") != me).limit(1).count():
            self.drop()
            self.__init__(self.spark, self.name, self.buckets)
        index = self.table().where(F.col("batch") != me)
        again = self.spark.table(f"{self.name}_again").where(F.col("batch") != me).groupBy("digest").agg(F.sum("n").alias("more"))
        groups = write_table(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("m").alias("n")), "digest-groups")
        new = groups.join(index.select("digest").hint("merge"), "digest", "left_anti")
        old = index.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"))
        known = groups.join(old.hint("merge"), "digest", "left").join(again.hint("merge"), "digest", "left").select(
            "digest",
            F.when(F.col("old_n").isNull(), F.col("keep_id")).otherwise(F.col("old_id")).alias("keep_id"),
            (F.col("n") + F.coalesce("old_n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("group_size"),
            F.col("old_n").isNull().alias("fresh"),
            (F.col("n") >= F.lit(max(1000, total * HOT_SHARE))).alias("hot"),
        )
        decided = write_table(known, "digest-decisions")

        def commit() -> None:
            seen = groups.join(index.select("digest").hint("merge"), "digest", "left_semi").select("digest", "n")
            for table, rows in ((f"{self.name}_again", seen), (self.name, new.select("digest", "keep_id", "n"))):
                if not self.spark.table(table).where(F.col("batch") == me).limit(1).count():
                    rows.withColumn("batch", F.lit(me)).write.insertInto(table)

        # a digest with many rows meets them through a broadcast of at most 1 / HOT_SHARE rows, the others by a merge join
        hot = decided.where("hot")
        left = batch.join(F.broadcast(hot.select("digest", F.lit(True).alias("is_hot"))), "digest", "left")
        rows = (
            left.where("is_hot").drop("is_hot").join(F.broadcast(hot), "digest")
            .unionByName(left.where("is_hot is null").drop("is_hot").join(decided.where("not hot").hint("merge"), "digest"))
        )
        rows = rows.select(
            "doc_id",
            "keep_id",
            F.col("group_size").cast("bigint").alias("group_size"),
            (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("is_keep"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("nth"),
        ).select(
            "doc_id", "keep_id", "group_size", (F.col("is_keep") & (F.col("nth") == 1)).alias("kept"), "text_sha256"
        )
        return Batch(rows, me, commit)

    def append(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batch_id: str | None = None, alone: bool = False) -> DataFrame:
        """dedup() and commit() in one. The result reads written tables only; if its consumer fails, append the batch again."""
        batch = self.dedup(docs, text, doc_id, batch_id, alone)
        batch.commit()
        return batch.rows


def exact_dedup(docs: DataFrame, name: str | None = None) -> DataFrame:
    """All of docs as the only batch of an index: of the named one, which stays, or of a fresh one, which goes. The cases
    are those of DigestIndex.dedup()."""
    index = DigestIndex(docs.sparkSession, name)
    rows = index.append(docs, alone=True)
    if name is None:
        index.drop()
    return rows


def index_name(path: str) -> str:
    """A table name for the index of the documents under a path."""
    return f"digests_{hashlib.md5(path.encode()).hexdigest()[:16]}"
