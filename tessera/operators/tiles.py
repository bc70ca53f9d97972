"""Exact nearest neighbours of many queries: tiles of queries meet tiles of the index on a salted grid.

Both sides are packed into tiles of bounded size, one row each. Index tiles are dealt to
``across`` groups, query tiles to ``down`` groups; a query tile goes to every group of
index tiles and the other way round, so each pair of tiles meets once, in one of
across x down grid cells. A task holds one cell at a time, about ``SIDES`` tiles of either
side, and scores it in blocks, keeping the k best of each query; what leaves a cell is k
rows per query, and those are merged per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shared_dir

#: Numbers and rows in a tile of either side at most, tiles of the index and of the queries in a grid cell, their pairs.
TILE_FLOATS, TILE_ROWS, SIDES = 1 << 16, 1 << 10, (64, 32)
PAIRS = SIDES[0] * SIDES[1]
_TILE = "tile long, n int, dim int, ids binary, vectors binary"


def packed(vectors: DataFrame, floats: int = TILE_FLOATS) -> DataFrame:
    """tile, n, dim, ids, vectors (unit, doubles; the zero vector stays) of (id, embedding); null ids and vectors are skipped, vectors of another length get tiles of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def tile(dim: int, some: list) -> pa.RecordBatch:
            v = np.stack([x for _, x in some])
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(norm == 0, 1, norm)
            ids = np.array([i for i, _ in some], "<i8")
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(some)], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([v.astype("<f8").tobytes()], pa.binary())], ["tile", "n", "dim", "ids", "vectors"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.values.to_numpy(zero_copy_only=False)
                some = held.setdefault(len(x), [])
                some.append((i, x))
                if len(some) * max(len(x), 1) >= floats or len(some) >= TILE_ROWS:
                    yield tile(len(x), held.pop(len(x)))
                    number += 1
        for dim, some in held.items():
            yield tile(dim, some)
            number += 1

    own = vectors.toDF("id", "embedding").filter("id is not null and embedding is not null")
    return own.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, _TILE)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of every row, ties by id; scores of -inf don't count."""
    fits = np.isfinite(scores)
    if scores.shape[1] > k:
        fits &= scores >= np.partition(scores, -k, axis=1)[:, -k][:, None]
    q, c = np.nonzero(fits)
    order = np.lexsort((ids[c], -scores[q, c], q))
    q, c = q[order], c[order]
    use = np.arange(len(q)) - np.searchsorted(q, np.arange(len(scores)))[q] < k
    return q[use], c[use]


class Best:
    """The ``k`` best scores and ids of each of ``n`` queries so far, ties by id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, s: np.ndarray, ids: np.ndarray) -> None:
        """Unrounded scores (queries x ids); -inf and nan don't count."""
        n, k = self.scores.shape
        least = self.scores[:, -1]
        if s.shape[1] > k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(np.where(np.isnan(s), -np.inf, s), -k, axis=1)[:, -k])
        q, c = np.nonzero(s >= least[:, None] - 2e-9)  # what rounds to the k-th stays in
        real = np.isfinite(s[q, c])
        q, c = q[real], c[real]
        if not len(q):
            return
        some, at = np.unique(q, return_inverse=True)
        held, cols = np.nonzero(np.isfinite(self.scores[some]))
        row = np.concatenate([at, held])
        score, own = np.concatenate([np.round(s[q, c], 9), self.scores[some[held], cols]]), np.concatenate([ids[c], self.ids[some[held], cols]])
        order = np.lexsort((own, -score, row))
        row, score, own = row[order], score[order], own[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(some)))[row]
        use = place < k
        self.scores[some[row[use]], place[use]], self.ids[some[row[use]], place[use]] = score[use], own[use]

    def rows(self, qids: np.ndarray) -> list[pa.Array]:
        """qid, vec_id, score."""
        use = np.isfinite(self.scores)
        return [pa.array(np.broadcast_to(qids[:, None], use.shape)[use]), pa.array(self.ids[use]), pa.array(self.scores[use])]


def _met(k: int, but_itself: bool):
    def side(t: pa.Table, ids: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
        dim = t.column("dim")[0].as_py()
        own = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in t.column(ids)])
        return own, np.concatenate([np.frombuffer(x.as_buffer(), "<f8") for x in t.column(vectors)]).reshape(len(own), dim)

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if index.num_rows and queries.num_rows:
            (ids, x), (qids, q) = side(index, "ids", "vectors"), side(queries, "qids", "queries")
            for i in range(0, len(q), TILE_ROWS):
                asked, found = qids[i : i + TILE_ROWS], Best(len(q[i : i + TILE_ROWS]), k)
                for j in range(0, len(x), TILE_ROWS):
                    s = q[i : i + TILE_ROWS] @ x[j : j + TILE_ROWS].T
                    if but_itself:
                        s[asked[:, None] == ids[j : j + TILE_ROWS]] = -np.inf
                    found.add(s, ids[j : j + TILE_ROWS])
                out.append(pa.RecordBatch.from_arrays(found.rows(asked), ["qid", "vec_id", "score"]))
        return pa.Table.from_batches(out, pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return run


def grid(index_tiles: int, query_tiles: int, tasks: int) -> tuple[int, int]:
    """(across, down): groups of index tiles and of query tiles, enough for the tasks and for ``SIDES`` a cell, the larger side cut finer."""
    cells = max(tasks, math.ceil(index_tiles * query_tiles / PAIRS))
    across = min(index_tiles, max(math.ceil(index_tiles / SIDES[0]), math.ceil(math.sqrt(cells * index_tiles / max(query_tiles, 1)))))
    return across, min(query_tiles, max(math.ceil(query_tiles / SIDES[1]), math.ceil(cells / across)))


def knn_join(index: DataFrame, queries: DataFrame, k: int, but_itself: bool = False) -> DataFrame:
    """qid, rank, vec_id, score (cosine, 9 places): the k nearest of ``index`` (vec_id, embedding) for every row of ``queries`` (qid, embedding).

    Nothing of either side passes through the driver but the number of tiles. Ties go to the
    smaller vec_id. A query whose length no vector of the index has gets no rows;
    ``but_itself``: a vector isn't its own neighbour.
    """
    spark = index.sparkSession
    folder = shared_dir(spark)
    saved = []
    for name, side in (("index", index.select("vec_id", "embedding")), ("queries", queries.select("qid", "embedding"))):
        packed(side).write.parquet(f"{folder}/{name}")
        saved.append(spark.read.schema(_TILE).parquet(f"{folder}/{name}"))
    tiles, asked = saved
    across, down = grid(max(tiles.count(), 1), max(asked.count(), 1), 2 * spark.sparkContext.defaultParallelism)
    group = lambda n: F.pmod(F.xxhash64("tile"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = tiles.select("dim", "ids", "vectors", group(across).alias("across")).withColumn("down", every(down))
    right = asked.select("dim", F.col("ids").alias("qids"), F.col("vectors").alias("queries"), group(down).alias("down")).withColumn("across", every(across))
    keys = ("across", "down", "dim")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_met(k, but_itself), "qid long, vec_id long, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "vec_id", "score")
