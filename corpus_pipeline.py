"""The corpus pipeline, part of subpackage llm: quality, near-duplicates, personal data, mixture, packing.

Each stage works on all rows that the one before kept. All but the last return the columns of `documents`; copies made by the mixture are
rows with equal ids. The last returns a row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
SQL can't express the first stage, so ORACLE_SQL is None and tests/llm/test_pipeline.py holds each stage against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termweave.llm import common, minhash, mixing, packing, pii, quality_gam
from termweave.llm.registry import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return quality_gam.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return minhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs).select(*[f"`{c}`" for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return packing.pack(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mixture", source_mixture),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(spark, docs, f"stage-{name}")
    return docs
