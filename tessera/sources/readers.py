"""Readers with explicit schemas for the corpus' files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDECAR = "source_id string, source_type string, title string, citation string, court_id string, date string, barrier string, url string, retrieved string, extracted_from string"
SCRAPE_SIDECAR = "volume_title string, part_title string, chapter_title string, chapter_url string, scraped_date string"
OPINION = "id long, xml_harvard string, plain_text string, absolute_url string, _corrupt_record string"
SELECTED = "opinion_id long, cluster_id long, case_name string, court_id string, date_filed string, citation string, cite_count long, found_by array<string>, barrier array<string>, why string, note string"
MANIFEST = f"selected array<struct<{SELECTED.replace(' ', ':').replace(',:', ',')}>>"
QUESTION = "questions array<struct<id:string,question:string,expected:array<struct<source_id:string,anchors:array<string>>>,acceptable:array<string>,note:string,head_to_head:boolean>>"
PROBE = "probes array<struct<id:string,question:string,kind:string,note:string,look_for:array<string>>>"


def _stem(suffix: str):
    return F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*){suffix}$", 1)


def texts(spark: SparkSession, *dirs: str) -> DataFrame:
    """source_id (file stem), text of the ``.txt`` files of all folders; Spark skips files of no bytes; blank lines dropped by the chunker."""
    read = lambda d: spark.read.text(d, wholetext=True, pathGlobFilter="*.txt").select(_stem(r"\.txt").alias("source_id"), F.regexp_replace("value", r"\n+$", "").alias("text"))
    return reduce(DataFrame.unionByName, map(read, dirs))


def sidecars(spark: SparkSession, *dirs: str, schema: str = SIDECAR) -> DataFrame:
    """Sidecar files by stem; a malformed one fails the read."""
    read = lambda d: spark.read.schema(schema).json(d, multiLine=True, mode="FAILFAST", pathGlobFilter="*_metadata.json").withColumn("stem", _stem(r"_metadata\.json"))
    return reduce(DataFrame.unionByName, map(read, dirs))


def documents(spark: SparkSession, *dirs: str) -> DataFrame:
    """Texts with their sidecars; ``missing`` where there is none."""
    own = sidecars(spark, *dirs).drop("source_id").withColumnRenamed("stem", "source_id").withColumn("_there", F.lit(True))
    return texts(spark, *dirs).join(own, "source_id", "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def opinions(spark: SparkSession, folder: str) -> DataFrame:
    """Opinion payloads; malformed ones keep their text in ``_corrupt_record``."""
    return spark.read.schema(OPINION).json(folder, multiLine=True, mode="PERMISSIVE", pathGlobFilter="opinion_*.json").withColumn("stem", _stem(r"\.json"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Selected records, one row each."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.inline("selected"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).json(path, multiLine=True).select(F.posexplode("questions").alias("position", "q")).select("position", "q.*")


def probes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBE).json(path, multiLine=True).select(F.posexplode("probes").alias("position", "q")).select("position", "q.*")


def first_texts(spark: SparkSession, *dirs: str) -> DataFrame:
    """source_id, text: like :func:`texts`, but of files with one stem the first folder's counts."""
    read = [texts(spark, d).withColumn("_at", F.lit(i)) for i, d in enumerate(dirs)]
    return reduce(DataFrame.unionByName, read).groupBy("source_id").agg(F.min_by("text", "_at").alias("text"))


RUN = (
    "config struct<model:string,k:int,thinking:string,provider:string,questions:array<string>,run:int>, totals map<string,double>, "
    "questions array<struct<id:string,probe:boolean,answer:string,degraded_category:string,citations:int,unknown:array<string>,malformed:array<string>,cited:array<string>,off_target_cites:array<string>,anchors:int,anchors_in_cited:int,anchors_in_context:int,refused_verbatim:boolean,truncated:boolean,expected_retrieved:array<string>,expected_cited:array<string>,usage:map<string,bigint>,seconds:double>>"
)


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    """Run files (config, totals, questions) of a folder with their names, in one pass; a malformed one fails the read."""
    return spark.read.schema(RUN).json(folder, multiLine=True, mode="FAILFAST", pathGlobFilter="*.json").withColumn("file", F.col("_metadata.file_name"))


#: A fetch attempt as landed: one JSON object a line.
ATTEMPT = "url string, attempt int, status int, retry_after string, body string, error string"


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Fetch attempts (pages or JSON replies) that a fetcher outside the engine has written; malformed lines have null url."""
    return spark.read.schema(ATTEMPT).json(folder, mode="PERMISSIVE")


def chapter_sidecar(scraped: DataFrame) -> DataFrame:
    """The corpus sidecar of scraped chapters (stem and the five scrape fields)."""
    none = [F.lit(None).cast("string").alias(c) for c in ("citation", "court_id", "date", "barrier")]
    return scraped.select(F.col("stem").alias("source_id"), F.lit("uscis").alias("source_type"), F.concat_ws(" / ", "volume_title", "part_title", "chapter_title").alias("title"), *none, F.col("chapter_url").alias("url"), F.col("scraped_date").alias("retrieved"))


def opinion_sidecar(payloads: DataFrame, selected: DataFrame, root: str) -> DataFrame:
    """The corpus sidecar of opinions; payloads that weren't selected are left to the caller's anti join."""
    return payloads.join(selected, payloads.id == selected.opinion_id).select(F.col("stem").alias("source_id"), F.lit("caselaw").alias("source_type"), F.col("case_name").alias("title"), "citation", "court_id", F.col("date_filed").alias("date"), F.array_join("barrier", ",").alias("barrier"), F.concat(F.lit(root), F.col("absolute_url")).alias("url"))
