"""Shared helpers: reading, anti-joins on ids, native span finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop_table, write_table
from ..shipping import ship_package

__all__ = ["NO_SPANS", "drop_table", "write_table", "UPPER", "prepare", "tables", "without_ids", "let", "find_spans", "tagged", "joined", "sha_hex"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prepare(spark: SparkSession) -> None:
    """For operators with Python workers: Arrow batches end at 16 MB as well, so that a worker's memory doesn't follow
    the length of texts, and workers get this package through Spark, wherever they start."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    ship_package(spark)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that a broadcast may hold (8 bytes each); beyond that a merge join takes its place.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't among ids; rows without an id stay."""
    ids = write_table(ids.select(F.col(ids.columns[0]).cast("bigint").alias("_gk_gone")).distinct(), "gone-ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    return docs.join(side, docs[doc_id] == F.col("_gk_gone"), "left_anti")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


BLOCK = 64


def find_spans(text: Column, pattern: str, around=None, more: str = "") -> Column:
    """array<struct<s int, e int, t string>> of a Java pattern's leftmost non-overlapping matches, in code points.

    around(before, after) may give further columns, of the types that more tells (",p:string"), from the text between a
    match and its neighbours. The pieces between matches and the matches themselves give the offsets; two-level block sums keep this near linear
    for texts with many matches. The pattern never matches the empty string.
    """
    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")
    )

    def with_steps(v):
        n = F.size(v["hits"])
        steps = F.transform(v["hits"], lambda h, i: F.length(F.get(v["gaps"], i)) + F.length(h))
        return let(steps, lambda st: with_blocks(v, st, n))

    def with_blocks(v, steps, n):
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
            lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x),
        )
        return let(blocks, lambda bl: let(F.transform(bl, lambda _, b: F.aggregate(F.slice(bl, F.lit(1), b), F.lit(0), lambda a, x: a + x)), lambda before: spans(v, steps, before)))

    def spans(v, steps, before):
        def one(h, i):
            rest = i % BLOCK
            start = (
                F.get(before, F.floor(i / BLOCK).cast("int"))
                + F.aggregate(F.slice(steps, i - rest + 1, rest), F.lit(0), lambda a, x: a + x)
                + F.length(F.get(v["gaps"], i))
            )
            beside = around(F.get(v["gaps"], i), F.get(v["gaps"], i + 1)) if around else ()
            return F.struct(start.alias("s"), (start + F.length(h)).alias("e"), h.alias("t"), *beside)

        return F.transform(v["hits"], one)

    return let(both, lambda v: F.when(F.size(v["hits"]) > 0, with_steps(v)).otherwise(NO_SPANS(more)))


def NO_SPANS(more: str = "") -> Column:
    return F.expr(f"cast(array() as array<struct<s:int,e:int,t:string{more}>>)")


def tagged(spans: Column, rank: int, kind: str) -> Column:
    """Spans without their text, as struct<s, k, e, kind>: its order is by start, then kind as listed."""
    return F.transform(
        spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"))
    )


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of tagged spans."""
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda x: F.concat(x["kind"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")),
        ),
        ",",
    )


def sha_hex(s: Column) -> Column:
    return F.sha2(s, 256)
