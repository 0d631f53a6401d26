"""The stages of ``corpus_pipeline.py``: documents in, documents out, except for the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import mixing, near_copies, packing, quality, toxicity
from memloom.llm.shared import table


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, folder, "labels"))


def drop_outliers(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return mixing.take_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack_documents(docs)
