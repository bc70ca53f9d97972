"""Incremental ingest: new document files become chunks as they arrive (an extension to the batch rebuild)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.chunking import chunks

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).parquet(folder)


def ingest(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append chunks of new documents to ``target``, each file once."""
    return chunks(docs).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
