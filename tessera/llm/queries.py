"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessera.llm import chat, decontaminate, exact_dedup, hard_negatives, langid, near_dedup, packing, quality, quality_rules, secret_scan, spelling, token_counts, token_files
from tessera.llm.common import table


def _docs(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": lambda spark, d: token_files.op1(spark, table(spark, d, "documents")),
    "op2_secret_scan": _docs(secret_scan.op2),
    "op3_token_counts": lambda spark, d: token_counts.op3(spark, table(spark, d, "documents")),
    "op4_quality": lambda spark, d: quality.op4(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_packing": _docs(packing.op5),
    "op6_exact_dedup": _docs(exact_dedup.op6),
    "op7_near_dedup": _docs(near_dedup.op7),
    "op8_chat_format": lambda spark, d: chat.op8(spark, table(spark, d, "conversations")),
    "op9_decontaminate": lambda spark, d: decontaminate.op9(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op10_language_id": _docs(langid.op10),
    "op11_spelling_variants": _docs(spelling.op11),
    "op12_quality_rules": _docs(quality_rules.op12),
    "op13_hard_negatives": lambda spark, d: hard_negatives.op13(table(spark, d, "embeddings")),
    "pipeline": corpus_pipeline.run,
}

#: Where SQL can express a query: by its definition, not by its method.
ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_near_dedup": near_dedup.ORACLE,
    "op8_chat_format": chat.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_quality_rules": quality_rules.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
