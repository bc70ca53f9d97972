"""Ingest policies as data: failures, breaker, resume, drift, required fields, metadata joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import retry_after, status_category

# The categories that count towards the breaker, and its limit.
BREAKER_CATEGORIES = ("rate_limited", "forbidden", "server_error", "timeout", "connection_error")
BREAKER_LIMIT = 3
RETRYABLE = (429, 500, 502, 503, 504)
EXCLUDED_COURTS = ("bia", "olc")


def breaker(log: DataFrame, is_failure: Column, limit: int = BREAKER_LIMIT) -> DataFrame:
    """Per key: the position at which ``limit`` failures in a row stop the run; (key, seq). Gaps and islands."""
    order = Window.partitionBy("key").orderBy("seq")
    marked = log.withColumn("_f", is_failure).withColumn("_island", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(order)).filter("_f")
    run = F.row_number().over(Window.partitionBy("key", "_island").orderBy("seq"))
    return marked.withColumn("run", run).filter(F.col("run") == limit).groupBy("key").agg(F.min("seq").alias("stop_at"))


def failures_by_category(failures: DataFrame) -> DataFrame:
    return failures.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def resume(selection: DataFrame, fetched: DataFrame) -> DataFrame:
    """What is still to be fetched."""
    return selection.join(fetched, "id", "left_anti")


def drift(expected: DataFrame, counts: DataFrame) -> DataFrame:
    """Searches (name, expected) whose count differs from what is expected or is missing."""
    return expected.join(counts, "name", "left").select("name", "expected", "found", (~F.col("expected").eqNullSafe(F.col("found"))).alias("drifted"))


def incomplete(selection: DataFrame) -> DataFrame:
    """Selected records without one of the required fields."""
    empty = F.col("opinion_id").isNull() | F.coalesce(F.size("barrier") <= 0, F.lit(True)) | (F.coalesce("why", F.lit("")) == "")
    return selection.filter(empty)


def with_sidecar(docs: DataFrame, sidecars: DataFrame, key: str) -> DataFrame:
    """Documents with their sidecar; ``missing`` marks those without, for quarantine."""
    return docs.join(sidecars.withColumn("_there", F.lit(True)), key, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def indexable(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped with reason) of (source_id, court_id, text): excluded courts and empty documents go."""
    reason = F.when(F.col("court_id").isin(*EXCLUDED_COURTS), F.concat(F.lit("excluded court "), F.col("court_id"))).when(~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)), "no content")
    tagged = docs.withColumn("reason", reason)
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null").select("source_id", "reason")


def tags(docs: DataFrame) -> DataFrame:
    """barrier, n: documents of every tag in the comma list."""
    return docs.select(F.explode(F.split("barrier", ",")).alias("barrier")).groupBy("barrier").agg(F.count(F.lit(1)).alias("n"))


def fetched(attempts: DataFrame) -> DataFrame:
    """url, attempts, body, category, wait of landed attempts (url, attempt, status, retry_after, body, error).

    The last attempt of each url decides: its body where the status is 200, else a category (the
    status' one, or ``error`` where no reply came) and the wait that the server asked for. Rows without url go.
    """
    last = attempts.filter("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("attempts"), F.max_by(F.struct("status", "retry_after", "body", "error"), "attempt").alias("x"))
    good = F.coalesce(F.col("x.status") == 200, F.lit(False))
    category = F.when(~good, F.when(F.col("x.status").isNotNull(), status_category(F.col("x.status"))).otherwise(F.coalesce("x.error", F.lit("connection_error"))))
    return last.select("url", "attempts", F.when(good, F.col("x.body")).alias("body"), category.alias("category"), F.when(~good, retry_after(F.col("x.retry_after"))).alias("wait"))


def by_tag(reports: DataFrame) -> DataFrame:
    """tag, documents, page_ids (rising): which documents hold each unhandled tag; (page_id, unhandled array<string>)."""
    return reports.select("page_id", F.explode("unhandled").alias("tag")).groupBy("tag").agg(F.countDistinct("page_id").alias("documents"), F.array_sort(F.collect_set("page_id")).alias("page_ids"))
