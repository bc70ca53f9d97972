"""Scores of a retrieval run: per question, per cap, and the table of what a cap would change.

Tables: ``hits`` (qid, rank, source_id, chunk_index, chunk_total, score) is the ranked pool,
``chunks`` (source_id, chunk_index, text) the index, ``expected`` (qid, source_id),
``anchors`` (qid, position, anchor) and ``acceptable`` (qid, source_id) the answer key.
A question has few hits and anchors, so all joins are equi-joins on it. Anchors have no line
breaks, so none lies across two chunks; null anchors are never found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import search, windows


def cutoffs_with(k: int, cutoffs: tuple[int, ...] = search.CUTOFFS) -> list[int]:
    """The curve's cutoffs and ``k``, each once, rising."""
    return sorted({*cutoffs, k})


def anchors_held(hits: DataFrame, chunks: DataFrame, anchors: DataFrame, width: int = windows.WIDTH) -> DataFrame:
    """qid, source_id, neighbor, position, anchor: what anchors each chunk in the windows of a question's hits contains.

    The anchors go to the chunks, so a text moves once, whatever number of hits, questions or anchors looks at it.
    """
    sought = windows.neighbors(hits, width).select("qid", "source_id", "neighbor").distinct().join(anchors.select("qid", "position", "anchor").filter("anchor is not null").distinct(), "qid")
    texts = chunks.select("source_id", F.col("chunk_index").alias("neighbor"), "text")
    return sought.join(texts, ["source_id", "neighbor"]).filter(F.contains("text", "anchor")).select("qid", "source_id", "neighbor", "position", "anchor")


def anchors_shown(hits: DataFrame, held: DataFrame, anchors: DataFrame, width: int = windows.WIDTH) -> DataFrame:
    """qid, position, anchor, in_chunk, in_window of ``hits``, with what their chunks contain (``held``)."""
    own = windows.neighbors(hits, width).select("qid", "source_id", "neighbor", (F.col("neighbor") == F.col("chunk_index")).alias("in_chunk"))
    found = own.join(held, ["qid", "source_id", "neighbor"]).select("qid", "position", "anchor", "in_chunk", F.lit(True).alias("in_window"))
    every = anchors.select("qid", "position", "anchor", F.lit(False).alias("in_chunk"), F.lit(False).alias("in_window"))
    return every.union(found).groupBy("qid", "position", "anchor").agg(F.max("in_chunk").alias("in_chunk"), F.max("in_window").alias("in_window"))


def anchors_found(hits: DataFrame, chunks: DataFrame, anchors: DataFrame, width: int = windows.WIDTH) -> DataFrame:
    """qid, position, anchor, in_chunk, in_window: whether a hit's own text, or its neighbour window, contains the anchor."""
    return anchors_shown(hits, anchors_held(hits, chunks, anchors, width), anchors, width)


def _as_sources(hits: DataFrame) -> DataFrame:
    return hits.withColumn("source", F.col("source_id"))


def _counts(found: DataFrame) -> DataFrame:
    in_order = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("position", "anchor")))), lambda x: x["anchor"])
    return found.groupBy("qid").agg(F.count(F.lit(1)).alias("anchors"), F.count_if("in_chunk").alias("anchors_in_chunk"), F.count_if("in_window").alias("anchors_in_window"), in_order(~F.col("in_window")).alias("missing_anchors"))


def score_questions(hits: DataFrame, chunks: DataFrame, expected: DataFrame, anchors: DataFrame, acceptable: DataFrame, k: int = search.TOP_K) -> DataFrame:
    """One row for each question of ``expected``: recall (map of cutoff), hit, first_rank, top_score, anchors, anchors_in_chunk,
    anchors_in_window, missing_anchors, expected, found, off_target, crowding, crowded_by, crowded_off_target, ranked.

    All but recall and first_rank are of the first ``k`` hits. ``crowded_by`` is empty without hits.
    """
    pool, top = _as_sources(hits), hits.filter(F.col("rank") <= k)
    keys = expected.select("qid", F.col("source_id").alias("source")).distinct()
    allowed = keys.unionByName(acceptable.select("qid", F.col("source_id").alias("source"))).distinct()
    curve = search.recall_curve(pool, keys, cutoffs_with(k)).groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cutoff", "recall")))).alias("recall"))
    ranked = top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_id"))), lambda x: x["source_id"]).alias("ranked"), F.round(F.max(F.when(F.col("rank") == 1, F.col("score"))), 3).alias("top_score"))
    wanted = keys.groupBy("qid").agg(F.array_sort(F.collect_list("source")).alias("expected"))
    either = allowed.groupBy("qid").agg(F.collect_list("source").alias("allowed"))
    out = wanted.join(curve, "qid").join(either, "qid").join(search.first_rank(pool, keys), "qid", "left").join(ranked, "qid", "left").join(search.crowding(pool, k), "qid", "left").join(_counts(anchors_found(top, chunks, anchors)), "qid", "left")
    none = F.array().cast(out.schema["expected"].dataType)
    shown = F.coalesce("ranked", none)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "qid",
        "recall",
        (F.element_at("recall", F.lit(k)) > 0).alias("hit"),
        "first_rank",
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        zero("anchors"),
        zero("anchors_in_chunk"),
        zero("anchors_in_window"),
        F.coalesce("missing_anchors", F.array().cast("array<string>")).alias("missing_anchors"),
        "expected",
        F.filter("expected", lambda s: F.array_contains(shown, s)).alias("found"),
        F.filter(shown, lambda s: ~F.array_contains("allowed", s)).alias("off_target"),
        zero("crowding"),
        F.coalesce(F.col("crowded_by").cast("string"), F.lit("")).alias("crowded_by"),
        F.coalesce(~F.array_contains("allowed", F.col("crowded_by")), F.lit(False)).alias("crowded_off_target"),
        shown.alias("ranked"),
    )


def capped_scores(hits: DataFrame, chunks: DataFrame, expected: DataFrame, anchors: DataFrame, k: int = search.TOP_K, caps: tuple[int, ...] = search.CAPS) -> DataFrame:
    """qid, cap (0: none), recall, anchors_in_chunk, anchors_in_window of the first ``k`` under a cap on hits of one document."""
    keys = expected.select("qid", F.col("source_id").alias("source")).distinct()
    held = anchors_held(hits, chunks, anchors)

    def one(cap: int) -> DataFrame:
        pool = _as_sources(hits)
        own = search.capped(pool, cap, k) if cap else pool.filter(F.col("rank") <= k)
        found = _counts(anchors_shown(own.drop("source"), held, anchors)).select("qid", "anchors_in_chunk", "anchors_in_window")
        return search.recall_curve(own, keys, (k,)).join(found, "qid", "left").select("qid", F.lit(cap).alias("cap"), "recall", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("anchors_in_chunk", "anchors_in_window")))

    return reduce(DataFrame.unionByName, map(one, (0, *caps)))


def diversity_table(scores: DataFrame) -> DataFrame:
    """cap, recall, anchors_in_chunk, anchors_in_window, recall_points and window_change against no cap, and ``trap``: more documents, fewer anchors."""
    per = scores.groupBy("cap").agg(F.round(F.avg("recall"), 6).alias("recall"), F.sum("anchors_in_chunk").alias("anchors_in_chunk"), F.sum("anchors_in_window").alias("anchors_in_window"))
    base = per.filter("cap = 0").select(F.col("recall").alias("_r"), F.col("anchors_in_window").alias("_w"))
    return per.crossJoin(F.broadcast(base)).select(  # one row
        "cap",
        "recall",
        "anchors_in_chunk",
        "anchors_in_window",
        F.round((F.col("recall") - F.col("_r")) * 100, 4).alias("recall_points"),
        (F.col("anchors_in_window") - F.col("_w")).alias("window_change"),
        ((F.col("recall") > F.col("_r")) & (F.col("anchors_in_window") < F.col("_w"))).alias("trap"),
    )
