"""Exact cosine top-k with metadata filters, caps, and the measures of a retrieval run.

Few queries are shipped to the index, which stays where it is: every partition keeps its
own k best for each query by matrix products of bounded size, and only those meet in a
window. Beyond ``BLOCK_ROWS`` queries or ``BLOCK_FLOATS`` numbers, tiles of queries meet
tiles of the index (:mod:`tiles`), and no query passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import tiles

# Depths of the measures.
TOP_K, POOL, CUTOFFS, CAPS = 8, 20, (1, 3, 5, 8, 10), (1, 2, 3)
#: Queries that are shipped at most, numbers in them, rows of the index scored at once.
BLOCK_ROWS, BLOCK_FLOATS, ROWS = 1_024, 1 << 20, 1_024


def _best(ids: np.ndarray, matrix: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tiles.Best(len(ids), k)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                keys, col = batch.column(0).slice(i, ROWS), batch.column(1).slice(i, ROWS)
                ok = pc.fill_null(pc.equal(pc.list_value_length(col), matrix.shape[1]), False)
                keys = keys.filter(ok).to_numpy(zero_copy_only=False)
                if len(keys):
                    v = col.filter(ok).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), -1)
                    norm = np.linalg.norm(v, axis=1, keepdims=True)
                    found.add(matrix @ (v / np.where(norm == 0, 1, norm)).T, keys)
        yield pa.RecordBatch.from_arrays(found.rows(ids), ["qid", "vec_id", "score"])

    return run


def _shipped(queries: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, unit vectors) of the queries; None if they are too many or of several lengths."""
    some = queries.limit(BLOCK_ROWS + 1).toArrow()
    n = pc.list_value_length(some.column(1)).unique()
    if some.num_rows > BLOCK_ROWS or len(n) != 1 or not 0 < some.num_rows * n[0].as_py() <= BLOCK_FLOATS:
        return None
    v = pc.list_flatten(some.column(1)).to_numpy().astype(float).reshape(some.num_rows, -1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return some.column(0).to_numpy(), v / np.where(norm == 0, 1, norm)


def search(index: DataFrame, queries: DataFrame, k: int = TOP_K, where: Column | None = None) -> DataFrame:
    """qid, rank, vec_id, score (rounded to 9 places): the k nearest of ``index`` (vec_id, embedding) for each of ``queries`` (qid, embedding).

    Ties go to the smaller vec_id. Null vectors are skipped, as are those of another length than the query's.
    """
    kept = (index.filter(where) if where is not None else index).select("vec_id", "embedding")
    asked = queries.select("qid", "embedding").filter("qid is not null and embedding is not null")
    shipped = _shipped(asked)
    if shipped is None:
        return tiles.knn_join(kept, asked, k)
    near = kept.filter("vec_id is not null").mapInArrow(_best(*shipped, k), "qid long, vec_id long, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "vec_id", "score")


def metadata_filter(source_type: str | None = None, tag: str | None = None) -> Column | None:
    """Equality on source_type and exact membership in the comma list ``barrier``."""
    parts = []
    if source_type is not None:
        parts.append(F.col("source_type") == source_type)
    if tag is not None:
        parts.append(F.array_contains(F.split("barrier", ","), tag))
    return reduce(Column.__and__, parts) if parts else None


def checked_filter(index: DataFrame, source_type: str | None = None, tag: str | None = None) -> Column | None:
    """:func:`metadata_filter`; a tag that no row of ``index`` has raises and names those that are there."""
    if tag is not None:
        known = index.select(F.explode(F.split("barrier", ",")).alias("tag")).filter("tag <> ''").distinct()
        if not known.filter(F.col("tag") == tag).limit(1).count():
            raise ValueError(f"no chunks tagged {tag}; tagged values: {', '.join(r.tag for r in known.orderBy('tag').limit(1000).collect())}")
    return metadata_filter(source_type, tag)


def by_ids(index: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the index by their ids; unknown ids give none."""
    return index.join(ids.select(key).distinct(), key, "left_semi")


def chunk_texts(index: DataFrame, source_id: str) -> DataFrame:
    """chunk_index, text of one document."""
    return index.filter(F.col("source_id") == source_id).select("chunk_index", "text")


def capped(hits: DataFrame, cap: int, k: int) -> DataFrame:
    """At most ``cap`` hits of a source, re-ranked, down to ``k``; (qid, rank, source, ...)."""
    within = F.row_number().over(Window.partitionBy("qid", "source").orderBy("rank"))
    again = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return hits.withColumn("_w", within).filter(F.col("_w") <= cap).drop("_w").withColumn("rank", again).filter(F.col("rank") <= k)


def recall_curve(hits: DataFrame, expected: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """qid, cutoff, recall: the share of expected (qid, source) within the first ``cutoff`` hits (qid, rank, source)."""
    first = hits.groupBy("qid", "source").agg(F.min("rank").alias("rank"))
    found = expected.distinct().join(first, ["qid", "source"], "left").withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs))))
    return found.groupBy("qid", "cutoff").agg(F.round(F.avg(F.when(F.col("rank") <= F.col("cutoff"), 1.0).otherwise(0.0)), 6).alias("recall"))


def first_rank(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """qid, first_rank of an expected source; null where none is in the pool."""
    found = hits.join(expected, ["qid", "source"]).groupBy("qid").agg(F.min("rank").alias("first_rank"))
    return expected.select("qid").distinct().join(found, "qid", "left")


def crowding(hits: DataFrame, k: int = TOP_K) -> DataFrame:
    """qid, crowding (most hits of one source in the first k) and crowded_by (ties: the one that ranks first)."""
    n = hits.filter(F.col("rank") <= k).groupBy("qid", "source").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    return n.groupBy("qid").agg(F.max("n").alias("crowding"), F.max_by("source", F.struct("n", -F.col("first"))).alias("crowded_by"))


def off_target(hits: DataFrame, allowed: DataFrame, k: int = TOP_K) -> DataFrame:
    """The first k hits whose source is neither expected nor acceptable."""
    return hits.filter(F.col("rank") <= k).join(allowed.select("qid", "source").distinct(), ["qid", "source"], "left_anti").select("qid", "rank", "source")


def diversity(hits: DataFrame, expected: DataFrame, caps=CAPS, k: int = TOP_K) -> DataFrame:
    """cap (0: none), mean recall at k over questions."""
    one = lambda c: recall_curve(capped(hits, c, k) if c else hits, expected, (k,)).agg(F.round(F.avg("recall"), 6).alias("recall")).select(F.lit(c).alias("cap"), "recall")
    return reduce(DataFrame.unionAll, [one(c) for c in (0, *caps)])
