"""The corpus pipeline: stages that each take the Parquet that the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.common import drop_table, tables, without_ids, write_table
from grovekit.llm.decontaminate import find_leaks
from grovekit.llm.line_dedup import delete_repeated_lines
from grovekit.llm.mixing import mixed_texts
from grovekit.llm.near_dedup import near_dedup
from grovekit.llm.quality import fit_quality
from grovekit.scratch import scratch_run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return fit_quality(docs, tables(spark, sf_dir, "labels")).keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has; documents that lose all of their text go."""
    return delete_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return without_ids(docs, near_dedup(docs, words=5, num=80, den=100).where(~F.col("kept")).select("doc_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return without_ids(docs, find_leaks(docs, tables(spark, sf_dir, "benchmark")).select("doc_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document is taken, with its place in the mix."""
    return mixed_texts(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: SQL cannot express the stages (a trained classifier, patience diff, iterated components, permutations).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. A stage's own tables go once its
    result is written, and so does its predecessor's result."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_run(spark) as kept:
            after = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(after)
        drop_table(docs)
        docs = after
    return docs
