"""Neighbour windows of hits, source blocks and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip_overlap

WIDTH = 1


def neighbors(hits: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per hit and neighbour index in range; an equi-join key instead of a band.

    ``hits``: qid, rank, source_id, chunk_index, chunk_total.
    """
    low = F.greatest(F.lit(0), F.col("chunk_index") - width)
    high = F.least(F.col("chunk_total") - 1, F.col("chunk_index") + width)
    return hits.withColumn("neighbor", F.explode(F.sequence(low, high)))


def window(hits: DataFrame, chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """Neighbour texts of every hit: qid, rank, source_id, neighbor, text."""
    texts = chunks.select("source_id", F.col("chunk_index").alias("neighbor"), "text")
    return neighbors(hits, width).join(texts, ["source_id", "neighbor"]).select("qid", "rank", "source_id", "neighbor", "text")


def deduped_window(hits: DataFrame, width: int = WIDTH) -> DataFrame:
    """Who shows which chunk: a hit shows itself, any other neighbour goes to the best-ranked hit that wants it."""
    own = neighbors(hits, width).withColumn("is_self", F.col("neighbor") == F.col("chunk_index"))
    by = Window.partitionBy("qid", "source_id", "neighbor").orderBy(F.desc("is_self"), "rank")
    return own.withColumn("_n", F.row_number().over(by)).filter("_n = 1").select("qid", "rank", "source_id", "neighbor")


def printed_window(hits: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per hit and neighbour: the rank of the hit that the neighbour itself is, if any (not de-duplicated)."""
    ranks = hits.select("qid", "source_id", F.col("chunk_index").alias("neighbor"), F.col("rank").alias("is_result"))
    out = neighbors(hits, width).join(ranks, ["qid", "source_id", "neighbor"], "left")
    return out.select("qid", "rank", "source_id", "neighbor", F.when(F.col("neighbor") != F.col("chunk_index"), F.col("is_result")).alias("is_result"))


def source_blocks(hits: DataFrame, chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """qid, rank, label, source_id, text: widened, de-duplicated blocks without repeated overlap.

    Bodies follow in chunk order, each without the overlap with the one before it, from
    a fresh start where a chunk is shown elsewhere. A block then loses what it carries
    over from the closest earlier block of its document where that changes anything.
    A question has few hits, so its blocks fold in one row.
    """
    shown = deduped_window(hits, width).join(chunks.select("source_id", F.col("chunk_index").alias("neighbor"), "text"), ["source_id", "neighbor"])
    bodies = shown.groupBy("qid", "rank", "source_id").agg(F.array_sort(F.collect_list(F.struct("neighbor", "text"))).alias("b"))
    kind = "struct<at:int,last:string,parts:array<string>>"
    start = F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("parts")).cast(kind)

    def add(acc, x):
        text = F.when(acc["at"] == x["neighbor"] - 1, strip_overlap(acc["last"], x["text"])).otherwise(x["text"])
        return F.struct(x["neighbor"].cast("int").alias("at"), text.alias("last"), F.when(text != "", F.concat(acc["parts"], F.array(text))).otherwise(acc["parts"]).alias("parts")).cast(kind)

    blocks = bodies.select("qid", "rank", "source_id", F.aggregate("b", start, add, lambda a: F.array_join(a["parts"], "\n")).alias("text"))
    per = blocks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "source_id", "text"))).alias("s"))
    done = "array<struct<rank:int,source_id:string,text:string>>"

    def carry(acc, x):
        earlier = F.reverse(F.filter(acc, lambda e: e["source_id"] == x["source_id"].cast("string")))
        stripped = F.aggregate(earlier, x["text"], lambda t, e: F.when(t != x["text"], t).otherwise(strip_overlap(e["text"], x["text"])))
        return F.concat(acc, F.array(F.struct(x["rank"].cast("int").alias("rank"), x["source_id"].cast("string").alias("source_id"), stripped.alias("text")))).cast(done)

    folded = per.select("qid", F.aggregate("s", F.array().cast(done), carry).alias("s"))
    return folded.select("qid", F.inline("s")).select("qid", "rank", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("label"), "source_id", "text")


def prompts(blocks: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, prompt: labelled blocks in rank order, then the question. ``blocks``: qid, rank, citation, section, text."""
    head = F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] "), F.col("citation"), F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" — "), F.col("section"))).otherwise(""))
    body = blocks.select("qid", "rank", F.concat(head, F.lit("\n"), F.col("text")).alias("b"))
    joined = body.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]), "\n\n---\n\n").alias("s"))
    return questions.join(joined, "qid").select("qid", F.concat(F.lit("SOURCES\n\n"), F.col("s"), F.lit("\n\nQUESTION\n\n"), F.col("question")).alias("prompt"))
