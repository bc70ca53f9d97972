"""Approximate nearest neighbours: an inverted file with product quantisation.

:func:`build` writes the index: every unit vector goes to the cell of its nearest centre
and is kept as a code of one byte for each group of components of what is left of it, in a
folder per cell, sorted by id; the vectors lie beside in the same layout. :func:`search`
ranks the centres for each query, reads the codes of the probed cells only (partition
pruning), scores them by table lookups, and fetches the vectors of the ``refine`` best per
query for exact scores.

Centres and code books are fit on a bounded sample (``SAMPLE_ROWS`` rows by hash of the id),
every row is indexed. How many cells are probed is measured: the fewest with which
``least`` of the sample's true neighbours lie in a probed cell (:func:`probes_for`), so on
data without clusters most cells are read and recall holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.tiles import best
from tessera.session import shared_dir

#: Rows of the sample, queries of it that are tried, cells within bounds, components a code stands for, values of a code.
SAMPLE_ROWS, TRIED, CELLS, GROUP, CODES = 16_384, 256, (4, 1_024), 4, 256
#: Queries in a pack, rows of a cell scored at once, rows that are assigned or probed for at once.
PACK, ROWS, STEP = 256, 4_096, 1_024


class Model(NamedTuple):
    centres: np.ndarray  # cells x dim, unit
    books: np.ndarray  # groups x codes x components
    dim: int  # components of a vector; books cover them with zeros behind
    probes: int


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def _lloyd(x: np.ndarray, number: int, rounds: int = 8) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    centre = distinct[np.random.default_rng(7).permutation(len(distinct))[:number]]
    for _ in range(rounds):
        near = (np.square(centre).sum(1) - 2 * x @ centre.T).argmin(1)
        n = np.bincount(near, minlength=len(centre))[:, None]
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(n > 0, total / np.maximum(n, 1), centre)
    return centre


def _grouped(x: np.ndarray, groups: int) -> np.ndarray:
    """rows x groups x components, zeros behind the last component."""
    return np.pad(x, ((0, 0), (0, groups * GROUP - x.shape[1]))).reshape(len(x), groups, GROUP)


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, least: float) -> int:
    """The fewest nearest cells that hold ``least`` of the true k neighbours of rows of ``x`` among ``x``."""
    tried = x[:: max(1, len(x) // TRIED)][:TRIED]
    k = min(k, len(x))
    near = np.argpartition(-(tried @ x.T), k - 1, axis=1)[:, :k]
    cell = (x @ centres.T).argmax(1)
    order = np.argsort(-(tried @ centres.T), axis=1)
    place = np.argsort(order, axis=1)  # of each cell among a query's
    depth = np.take_along_axis(place, cell[near], 1)
    return int(np.quantile(depth, least, method="higher")) + 1


def fit(index: DataFrame, k: int = 8, least: float = 0.96) -> Model | None:
    """Centres, books and probes from the sample; None for an index without vectors."""
    have = index.filter("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = have.count()
    if not n:
        return None
    rows = have.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("embedding").toArrow()
    x = _unit(np.stack(rows.column(0).to_numpy()))
    cells = min(max(CELLS[0], math.isqrt(n)), CELLS[1], len(x))
    centres = _unit(_lloyd(x, cells))
    rest = x - centres[(x @ centres.T).argmax(1)]
    groups = -(-x.shape[1] // GROUP)
    books = np.zeros((groups, CODES, GROUP))
    for g, part in enumerate(np.moveaxis(_grouped(rest, groups), 1, 0)):
        own = _lloyd(part, CODES)
        books[g, : len(own)] = own
        books[g, len(own) :] = own[0]
    return Model(centres, books, x.shape[1], probes_for(x, centres, k, least))


def _steps(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``step`` rows at most."""
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def build(index: DataFrame, path: str, model: Model) -> str:
    """Write ``codes`` (cell, vec_id, code) and ``vectors`` (cell, vec_id, vector) of ``index`` (vec_id, embedding) under ``path``.

    Null ids and vectors are left out; so are vectors of another length than the model's, which raise.
    """
    centres, books, dim = model.centres, model.books, model.dim
    squares = np.square(books).sum(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, STEP):
            x = _unit(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float))
            if x.shape[1] != dim:
                raise ValueError(f"vectors of {x.shape[1]} components in an index of {dim}")
            cell = (x @ centres.T).argmax(1)
            rest = _grouped(x - centres[cell], len(books))
            codes = np.stack([(squares[g] - 2 * rest[:, g] @ books[g].T).argmin(1) for g in range(len(books))], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "cell", "code", "vector"])

    own = index.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    coded = own.mapInArrow(run, "vec_id long, cell int, code binary, vector binary").repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    # by ranges of (cell, vec_id): a frequent cell is several tasks and files, a task holds few cells
    spark = index.sparkSession
    coded.write.parquet(f"{path}/coded")
    whole = spark.read.schema(coded.schema).parquet(f"{path}/coded")
    for name, column in (("codes", "code"), ("vectors", "vector")):
        whole.select("cell", "vec_id", column).sortWithinPartitions("cell", "vec_id").write.partitionBy("cell").parquet(f"{path}/{name}")
    coded_at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/coded")
    coded_at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(coded_at, True)
    return path


def _probed(queries: DataFrame, model: Model, probes: int) -> DataFrame:
    """cell, qid, base (the centre's share of the score), vector of every query and probed cell."""
    centres, dim = model.centres, model.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, max(1, ROWS // probes)):  # each query gives a row for each probed cell
            q = _unit(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float))
            if q.shape[1] != dim:
                raise ValueError(f"queries of {q.shape[1]} components for an index of {dim}")
            s = q @ centres.T
            cells = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            each = np.repeat(np.arange(len(q)), cells.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), batch.column(0).take(pa.array(each)), pa.array(np.take_along_axis(s, cells, 1).ravel()), pa.array([q[i].tobytes() for i in each], pa.binary())], ["cell", "qid", "base", "vector"])

    own = queries.filter("qid is not null and embedding is not null").select(F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.mapInArrow(run, "cell int, qid long, base double, vector binary")


def _blocks(rows: DataFrame, columns: list[str], size: int, schema: str) -> DataFrame:
    """Rows (cell, ...) in blocks of one cell and ``size`` at most: cell and a binary column for each of ``columns``, values one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(t: pa.Table) -> pa.RecordBatch:
            blob = [b"".join(c.to_pylist()) if pa.types.is_binary(c.type) else c.to_numpy().tobytes() for c in (t.column(name).combine_chunks() for name in columns)]
            return pa.RecordBatch.from_arrays([t.column("cell")[:1].combine_chunks(), *(pa.array([b], pa.binary()) for b in blob)], ["cell", *columns])

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows:
                cell = held.column("cell").to_numpy()
                run = int(np.argmax(cell != cell[0])) or len(cell)
                if run == len(cell) and run < size:
                    break
                take = min(run, size)
                yield block(held.slice(0, take))
                held = held.slice(take)
        if held is not None and held.num_rows:
            yield block(held)

    return rows.select("cell", *columns).mapInArrow(run, schema)


def candidates(spark: SparkSession, path: str, asked: DataFrame, model: Model, refine: int, cells: list[int]) -> DataFrame:
    """qid, cell, vec_id of the ``refine`` best codes of each query; reads the folders of ``cells`` only."""
    books, groups = model.books, len(model.books)
    codes = spark.read.schema("vec_id long, code binary, cell int").parquet(f"{path}/codes").filter(F.col("cell").isin(cells))
    stored = _blocks(codes, ["vec_id", "code"], ROWS, "cell int, vec_id binary, code binary")
    packs = _blocks(asked.repartition("cell", F.pmod(F.xxhash64("qid"), F.lit(16))).sortWithinPartitions("cell"), ["qid", "base", "vector"], PACK, "cell int, qid binary, base binary, vector binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qids, base, ids = np.frombuffer(r["qid"], "<i8"), np.frombuffer(r["base"]), np.frombuffer(r["vec_id"], "<i8")
                q = _grouped(np.frombuffer(r["vector"]).reshape(len(qids), -1), groups)
                code = np.frombuffer(r["code"], np.uint8).reshape(-1, groups)
                s = np.broadcast_to(base[:, None], (len(qids), len(ids))).copy()
                for g in range(groups):
                    s += (q[:, g] @ books[g].T)[:, code[:, g]]
                qi, ci = best(s, ids, refine)
                yield pa.RecordBatch.from_arrays([pa.array(qids[qi]), pa.array(np.full(len(qi), r["cell"], np.int32)), pa.array(ids[ci]), pa.array(s[qi, ci])], ["qid", "cell", "vec_id", "near"])

    scored = packs.join(stored, "cell").mapInArrow(run, "qid long, cell int, vec_id long, near double")
    order = Window.partitionBy("qid").orderBy(F.desc("near"), "vec_id")
    return scored.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= refine).select("qid", "cell", "vec_id")


class Found(NamedTuple):
    hits: DataFrame
    cells: int  # of the index
    probes: int  # of them that each query scores
    cells_read: int  # folders that any query needs


def search(spark: SparkSession, path: str, model: Model, queries: DataFrame, k: int, probes: int | None = None, refine: int | None = None) -> Found:
    """Hits (qid, rank, vec_id, score: exact cosine, 9 places; ties by vec_id) of the index at ``path`` for (qid, embedding)."""
    folder, probes = shared_dir(spark), min(probes or model.probes, len(model.centres))
    _probed(queries, model, probes).write.parquet(f"{folder}/asked")
    asked = spark.read.schema("cell int, qid long, base double, vector binary").parquet(f"{folder}/asked")
    cells = [r.cell for r in asked.select("cell").distinct().collect()]  # one number for a cell, of which there are CELLS[1] at most
    best_codes = candidates(spark, path, asked, model, refine or 8 * k, cells)
    vectors = spark.read.schema("vec_id long, vector binary, cell int").parquet(f"{path}/vectors").filter(F.col("cell").isin(cells))
    query = asked.groupBy("qid").agg(F.first("vector").alias("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, x = (np.frombuffer(b"".join(batch.column(i).to_pylist())).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round((q * x).sum(1), 9))], ["qid", "vec_id", "score"])

    pairs = best_codes.join(vectors, ["cell", "vec_id"]).join(query, "qid").select("qid", "vec_id", "query", "vector")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    hits = pairs.mapInArrow(run, "qid long, vec_id long, score double").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "vec_id", "score")
    return Found(hits, len(model.centres), probes, len(cells))


def recall(found: Found, exact: DataFrame, index_rows: int) -> DataFrame:
    """One row: queries, neighbours (of the exact hits), recall, cells, probes, cells_read, rows of the index."""
    both = exact.select("qid", "vec_id").join(found.hits.select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    return both.agg(F.countDistinct("qid").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall")).select("*", F.lit(found.cells).alias("cells"), F.lit(found.probes).alias("probes"), F.lit(found.cells_read).alias("cells_read"), F.lit(index_rows).cast("long").alias("rows"))
