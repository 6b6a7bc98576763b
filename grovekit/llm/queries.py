"""Registered queries of the training-data operators: each runs over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .common import tables
from .decontaminate import find_leaks
from .exact_dedup import exact_dedup, index_name
from .html_extract import extract_main_text
from .line_dedup import line_dedup
from .mixing import mix_sources
from .near_dedup import near_dedup
from .pii import find_pii
from .quality import fit_quality
from .secret_scan import scan_secrets
from .substring_dedup import substring_dedup


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(tables(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    return fit_quality(docs, tables(spark, sf_dir, "labels")).score(docs)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(tables(spark, sf_dir, "documents"), with_bytes=False)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(tables(spark, sf_dir, "pages"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(tables(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(tables(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(tables(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(tables(spark, sf_dir, "documents")).drop("kept_text")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(tables(spark, sf_dir, "documents"), name=index_name(sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_quality": op2_quality,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_html_extract": op4_html_extract,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_pii": op6_pii,
        "op7_mixing": op7_mixing,
        "op8_line_dedup": op8_line_dedup,
        "op9_decontaminate": op9_decontaminate,
        "op10_exact_dedup": op10_exact_dedup,
        "pipeline": corpus_pipeline.run,
    }


ORACLES = {
    "op10_exact_dedup": """
        with t as (
            select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
            from documents
        )
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
        from t window w as (partition by text_sha256)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
