"""Five-stage clean-up of a document corpus; each stage is one operator of ``memloom.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import stages
from memloom.llm.shared import stored, table

#: Name and function of each stage; a function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("quality_rules", stages.drop_outliers),
    ("minhash_near_dedup", stages.drop_near_copies),
    ("source_mixing", stages.mix_sources),
    ("packing", stages.pack),
]

#: No stage but the quality base rules can be put in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written as Parquet and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
