"""Writers: documents, the index (always rebuilt whole), evaluation results, and the citation gate."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").partitionBy("source_type").parquet(path)


def rebuild_index(chunks: DataFrame, path: str) -> str:
    """Write a whole new version of the index beside the older ones and return its folder.

    An upsert would leave chunks of shortened documents behind, and an overwrite in place would
    lose the index where it fails; a version counts once it is listed, after it is written.
    """
    version = f"{time.time_ns()}-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{version}"
    chunks.write.parquet(folder)
    chunks.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/versions")
    return folder


def current_index(spark: SparkSession, path: str) -> DataFrame:
    """The newest listed version under ``path``."""
    newest = spark.read.schema("version string").json(f"{path.rstrip('/')}/versions").agg(F.max("version").alias("v")).first().v
    return spark.read.parquet(f"{path.rstrip('/')}/{newest}")


def write_raw(replies: DataFrame, path: str) -> None:
    """Raw replies (stem, body) as they came, one text file's folder for each stem."""
    replies.select("stem", F.col("body").alias("value")).write.mode("overwrite").partitionBy("stem").text(path)


def write_results(results: DataFrame, path: str, config: dict[str, object] | None = None) -> str:
    """Evaluation results as JSON; the configuration's values are part of the folder's name, which is returned."""
    name = "-".join(re.sub(r"[^A-Za-z0-9.]+", "_", f"{k}{v}") for k, v in (config or {}).items())
    folder = f"{path.rstrip('/')}/{name}" if name else path
    results.write.mode("overwrite").json(folder)
    return folder


def fabricated(records: DataFrame) -> int:
    """Citations of sources that weren't given; a run passes at 0."""
    return records.agg(F.coalesce(F.sum(F.size("unknown")), F.lit(0)).alias("n")).first().n
