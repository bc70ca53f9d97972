"""A corpus pipeline of five training-data operators, each stage written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, exact_dedup, langid, near_dedup, packing
from tessera.llm.common import dropped, saved, scratch_dir, table
from tessera.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters; mixtures of languages stay."""
    ship(spark)
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id."""
    ship(spark)
    return exact_dedup.deduped(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group keep the document with the smallest doc_id."""
    ship(spark)
    return near_dedup.deduped(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also edited."""
    ship(spark)
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: SQL can express neither the alignment nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs, folder = table(spark, sf_dir, "documents"), scratch_dir(spark)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if i:
            dropped(spark, f"{folder}/{STAGES[i - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
