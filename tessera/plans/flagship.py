"""The end-to-end slice: documents, chunks, vectors, search for the benchmark items, neighbour windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking, encoding, evaluation, scoring, search, windows
from tessera.session import shared_dir
from tessera.sources import sinks


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what is used more than once is made once."""
    path = f"{shared_dir(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(docs: DataFrame) -> DataFrame:
    """``docs`` on all cores where it has fewer splits than there are; a large table has enough and stays as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def chunk_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The chunks of ``docs``, written as an index of their own and read back, so that texts are chunked once."""
    return spark.read.parquet(sinks.rebuild_index(chunking.chunks(dealt(docs.select("doc_id", "text"))), f"{shared_dir(spark)}/chunks"))


def place_id(doc_id: Column, chunk_index: Column) -> Column:
    """doc_id and place in one number; raises where an id needs 44 bits or a document has 2^20 chunks, as numbers would meet."""
    fits = (F.abs(doc_id) < F.lit(1 << 43)) & (chunk_index < 1 << 20)
    return F.when(fits, F.shiftleft(doc_id, 20) + chunk_index).otherwise(F.raise_error(F.lit("no room for doc_id and chunk_index in one number")).cast("long"))


def placed_hits(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    """((qid, rank, vec_id, score, chunk_id, source_id, chunk_index, chunk_total) of every benchmark item's ``k`` nearest chunks, the chunks); equal scores rank by document and chunk."""
    encode = encoding.encoder()
    chunks = chunk_table(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own = chunks.withColumn("vec_id", place_id(F.col("doc_id"), F.col("chunk_index")))
    index = own.select("vec_id", encode(F.col("text")).alias("embedding"))
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), encode(F.col("text")).alias("embedding"))
    hits = search.search(index, queries, k)
    return stored(hits.join(own.select("vec_id", "chunk_id", F.col("doc_id").alias("source_id"), "chunk_index", "chunk_total"), "vec_id")), chunks


def retrieve(spark: SparkSession, sf_dir: str, k: int = search.TOP_K) -> DataFrame:
    """qid, rank, chunk_id, score, window_text of every benchmark item."""
    placed, chunks = placed_hits(spark, sf_dir, k)
    texts = chunks.select(F.col("doc_id").alias("source_id"), "chunk_index", "text")
    shown = windows.window(placed, texts)
    joined = shown.groupBy("qid", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("neighbor", "text"))), lambda x: x["text"]), "\n").alias("window_text"))
    return placed.join(joined, ["qid", "rank"]).select("qid", "rank", "chunk_id", "score", "window_text")


def scores(spark: SparkSession, sf_dir: str, pool: int = search.POOL) -> DataFrame:
    """The retrieval scores of that search: a question is a benchmark item that some document contains, those documents are expected, the item is its anchor.

    Columns as in :func:`scoring.score_questions`, recall as recall_1, recall_3, and so on.
    """
    placed, chunks = placed_hits(spark, sf_dir, pool)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("anchor"))
    held = evaluation.anchor_containment(items.select(F.col("qid").alias("anchor_id"), "anchor"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
    expected = stored(held.select(F.col("anchor_id").alias("qid"), F.col("doc_id").alias("source_id")))
    anchors = items.join(expected.select("qid").distinct(), "qid").select("qid", F.lit(0).alias("position"), "anchor")
    texts = chunks.select(F.col("doc_id").alias("source_id"), "chunk_index", "text")
    got = scoring.score_questions(placed, texts, expected, anchors, expected.limit(0))
    return got.select("*", *(F.element_at("recall", F.lit(n)).alias(f"recall_{n}") for n in scoring.cutoffs_with(search.TOP_K))).drop("recall")
