"""Hard negatives by one-dimensional distance keys.

The largest inner products become the nearest neighbours: a vector x gets one more
component sqrt(M^2 - |x|^2), M the largest norm, an anchor q gets 0, and then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Every augmented vector goes to its nearest pivot and has
one key, its distance to it. :func:`build` stores the vectors sorted by (pivot, distance)
in cells of bounded size, each a key interval of one pivot.

:func:`search` scans for each query the key intervals [d - r, d + r] around its own
distance d to every pivot: by the triangle inequality a cell outside holds nothing nearer
than r. After a round, a query is finished when its k-th best lies within r, as all that
is unseen is farther, or when r covers all scores that it allows; else r grows to the
distance of its k-th best, or doubles where it has fewer than k. A round scans only the
annuli between the old and the new r. Queries travel in packs of bounded size to the cells
that they need, a pack and a cell at a time, and what comes back is k rows per query and
cell; a third of all rows with one vector are many cells with one key.

Pivots are centres of a bounded sample (``SAMPLE_ROWS``); they decide how much is scanned,
never what is found. Components become floor(256 x); scores are exact integers as long as
they stay below 2^53, and are rounded to doubles beyond.

Rows with a null vec_id, label or vector, or any null, NaN or infinite component take no
part. Rows that repeat a vec_id are rows of their own, anchors too. Shorter vectors count
as if zeros followed. Ties go to the smaller vec_id. Without rows or anchors the result is
empty; columns other than vec_id, label and embedding are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import dropped, saved, scratch_dir

#: Numbers in a cell and in a pack of queries.
CELL_FLOATS, PACK_FLOATS = 1 << 16, 1 << 14
#: Rows of the sample for the pivots, and pivots: one for so many rows, within bounds.
SAMPLE_ROWS, ROWS_A_PIVOT, PIVOTS = 4_096, 2_048, (4, 256)
#: Rows of a cell are numbered within this many.
_WIDE = 1 << 17
#: Keys to which a pivot's cells are dealt where packs meet them.
_SALTS = 8
POSITIVES, NEGATIVES, LEAST_PERCENT, ANCHOR_EVERY = 5, 5, 80, 100
#: Packs of queries in the shared folder: what a task needs of each query beside its vector.
_PACK = "pack long, anchors int, row binary, at binary, slot binary, label binary, low binary, high binary, prev binary, now binary, vectors binary, spans array<struct<pivot:int,low:double,high:double,from:double,to:double>>"
_QUERY = ("row", "slot", "label", "low", "high", "prev", "now", "vector")


class Index(NamedTuple):
    cells: DataFrame  # cell, pivot, low, high, n, ids, labels, vectors
    pivots: np.ndarray  # whole numbers, so that distances come out alike wherever they are computed
    top: float  # M
    dim: int
    kind: str  # how a component is stored
    start: float  # a radius at which most queries of the sample have their k nearest


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (doubles), square, largest: the rows that take part, components as floor(256 x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, v in enumerate(batch.column(2).to_numpy(zero_copy_only=False)):
                x = np.asarray(v, float)
                if np.isfinite(x).all():
                    keep.append(i)
                    out.append(np.floor(256.0 * x))
            part = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            squares = [float(x @ x) for x in out]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in out], pa.binary()), pa.array(squares, pa.float64()), pa.array([float(np.abs(x).max(initial=0)) for x in out], pa.float64())], ["vec_id", "label", "vector", "square", "largest"])

    whole = rows.filter("vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null)")
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, label long, vector binary, square double, largest double")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of doubles, zeros where one is shorter."""
    out = np.zeros((len(column), dim))
    for row, v in zip(out, column.to_pylist(), strict=True):
        x = np.frombuffer(v)
        row[: len(x)] = x
    return out


def _lifted(squares: np.ndarray, top: float) -> np.ndarray:
    """The component that makes all norms alike."""
    return np.sqrt(np.maximum(top * top - squares, 0))


def _to_pivots(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots. Sums of whole numbers are exact in any order, so each comes out alike in every task."""
    centre, last = pivots[:, :-1], pivots[:, -1]
    square = (x * x).sum(1)[:, None] + (centre * centre).sum(1) - 2 * (x @ centre.T)
    return np.sqrt(np.maximum(square, 0) + np.square(extra[:, None] - last))


def _centres(x: np.ndarray, number: int, rounds: int = 5) -> np.ndarray:
    """Centres of the sample by Lloyd's rounds from spread-out rows, as whole numbers."""
    distinct = np.unique(x, axis=0)
    centre = distinct[np.linspace(0, len(distinct) - 1, min(number, len(distinct))).astype(int)]
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] + (centre * centre).sum(1) - 2 * (x @ centre.T)).argmin(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centre))[:, None]
        centre = np.where(n > 0, total / np.maximum(n, 1), centre)
    return np.unique(np.round(centre), axis=0)


def _reach(square, top: float, score):
    """The distance at which a score lies, a little more than exact: scores are whole numbers, so no score is mistaken."""
    return np.sqrt(np.maximum(square + top * top - 2 * score, 0)) * (1 + 1e-9) + 1e-6


def build(rows: DataFrame, folder: str, k: int) -> Index | None:
    """The index of (vec_id, label, embedding), saved in ``folder``; None where no row takes part."""
    points = saved(quantised(rows), f"{folder}/points")
    n, width, square, largest = points.agg(F.count(F.lit(1)), F.max(F.length("vector")), F.max("square"), F.max("largest")).first()
    if not n:
        return None
    dim, top, kind = max(width // 8, 1), float(np.sqrt(square)), "<f4" if largest <= 1 << 24 else "<f8"
    size = max(64, min(SAMPLE_ROWS, 64 * SAMPLE_ROWS // dim))
    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "vector").limit(size).select("vector", "square", "label").toArrow().combine_chunks()
    x, squares, labels = _matrix(sample.column(0), dim), sample.column(1).to_numpy(), sample.column(2).to_numpy()
    pivots = _centres(np.column_stack([x, _lifted(squares, top)]), min(max(n // ROWS_A_PIVOT, PIVOTS[0]), PIVOTS[1]))
    # where queries of the sample have their k-th neighbour of the same label
    some = slice(0, 128)
    scores = np.where(labels[some, None] == labels[None], x[some] @ x.T, -np.inf)
    kth = np.sort(scores, 1)[:, -min(k + 1, len(x))]
    seen = np.isfinite(kth)
    start = float(np.quantile(_reach(squares[some][seen], top, kth[seen]), 0.9)) if seen.any() else top / 4

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, sq = _matrix(batch.column(2), dim), batch.column(3).to_numpy()
                d = _to_pivots(v, _lifted(sq, top), pivots)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r.tobytes() for r in v.astype(kind)], pa.binary()), pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], ["vec_id", "label", "vector", "pivot", "distance"])

    per_cell = min(max(64, CELL_FLOATS // dim), _WIDE)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 24, None

        def cell(t: pa.Table, number: int) -> pa.RecordBatch:
            d = t.column(4).to_numpy()
            blob = lambda a: pa.array([a], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([t.column(3)[0].as_py()], pa.int32()), pa.array([d[0]]), pa.array([d[-1]]), pa.array([len(d)], pa.int32()), blob(t.column(0).to_numpy().astype("<i8").tobytes()), blob(t.column(1).to_numpy().astype("<i8").tobytes()), blob(b"".join(t.column(2).to_pylist()))],
                ["cell", "pivot", "low", "high", "n", "ids", "labels", "vectors"],
            )

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows:
                pivot = held.column(3).to_numpy()
                run = int(np.searchsorted(pivot, pivot[0], "right"))
                if run == held.num_rows and run < per_cell:
                    break  # its next rows may follow
                take = min(run, per_cell)
                yield cell(held.slice(0, take), number)
                number, held = number + 1, held.slice(take)
        if held is not None and held.num_rows:
            yield cell(held, number)

    by_key = points.mapInArrow(keyed, "vec_id long, label long, vector binary, pivot int, distance double").repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    cells = saved(by_key.mapInArrow(packed, "cell long, pivot int, low double, high double, n int, ids binary, labels binary, vectors binary"), f"{folder}/cells")
    dropped(rows.sparkSession, f"{folder}/points")
    return Index(cells, pivots, top, dim, kind, start)


def members(index: Index, every: int = ANCHOR_EVERY) -> DataFrame:
    """row, vec_id, label, vector of the rows whose vec_id ``every`` divides; ``row`` tells all rows of the index apart."""
    dim, kind = index.dim, index.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, ids, labels, vectors in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, labels, v = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(vectors, kind).reshape(-1, dim)
                at = np.flatnonzero(ids % every == 0)
                yield pa.RecordBatch.from_arrays([pa.array(cell * _WIDE + at), pa.array(ids[at]), pa.array(labels[at]), pa.array([v[i].tobytes() for i in at], pa.binary())], ["row", "vec_id", "label", "vector"])

    return index.cells.select("cell", "ids", "labels", "vectors").mapInArrow(run, "row long, vec_id long, label long, vector binary")


def _packs(index: Index, queries: DataFrame) -> DataFrame:
    """Queries that lie near each other in packs, with the key intervals at every pivot that they scan, and those that all of them have scanned."""
    dim, kind, pivots = index.dim, index.kind, index.pivots

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(7).to_pylist()), kind).reshape(-1, dim).astype(float)
                d = _to_pivots(x, np.zeros(len(x)), pivots)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], [*_QUERY, "home", "key"])

    most = max(16, PACK_FLOATS // dim)

    def pack(t: pa.Table, number: int) -> pa.RecordBatch:
        row = t.column(0).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        vectors = b"".join(t.column(7).take(pa.array(first)).to_pylist())
        at = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))
        x = np.frombuffer(vectors, kind).reshape(-1, dim).astype(float)
        d = _to_pivots(x, np.zeros(len(x)), pivots)[at]
        prev, now = t.column(5).to_numpy()[:, None], t.column(6).to_numpy()[:, None]
        ends = [a.tolist() for a in ((d - now).min(0), (d + now).max(0), (d - prev).max(0), (d + prev).min(0))]
        spans = [{"pivot": p, "low": a, "high": b, "from": c, "to": e} for p, (a, b, c, e) in enumerate(zip(*ends, strict=True))]
        blob = lambda a, k: pa.array([np.asarray(a).astype(k).tobytes()], pa.binary())
        col = lambda i: t.column(i).to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([len(first)], pa.int32()), blob(row, "<i8"), blob(at, "<i4"), blob(col(1), "<i4"), blob(col(2), "<i8"), blob(col(3), "<f8"), blob(col(4), "<f8"), blob(col(5), "<f8"), blob(col(6), "<f8"), pa.array([vectors], pa.binary()), pa.array([spans], pa.list_(pa.struct([("pivot", pa.int32()), *((c, pa.float64()) for c in ("low", "high", "from", "to"))])))],
            ["pack", "anchors", "row", "at", "slot", "label", "low", "high", "prev", "now", "vectors", "spans"],
        )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            t = pa.Table.from_batches([batch])
            row = batch.column(0).to_numpy()
            nth = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]])) // most
            for i in np.unique(nth):  # an anchor's queries stay together within a batch; across two they are two anchors
                at = np.flatnonzero(nth == i)
                yield pack(t.slice(int(at[0]), len(at)), number)
                number += 1

    kinds = "row long, slot int, label long, low double, high double, prev double, now double, vector binary"
    near = queries.select(*_QUERY).mapInArrow(placed, f"{kinds}, home int, key double").repartitionByRange("home", "key", "row").sortWithinPartitions("home", "key", "row", "slot")
    return near.drop("home", "key").mapInArrow(packed, _PACK)


def _scan(index: Index, k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over pairs of a pack and a cell: the k best rows of the cell for every query that hasn't scanned it."""
    dim, kind, pivots = index.dim, index.kind, index.pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                row, at, slot, label, low, high, prev, now = (np.frombuffer(r[c], t) for c, t in (("row", "<i8"), ("at", "<i4"), ("slot", "<i4"), ("label", "<i8"), ("low", "<f8"), ("high", "<f8"), ("prev", "<f8"), ("now", "<f8")))
                q = np.frombuffer(r["vectors"], kind).reshape(-1, dim).astype(float)
                d = _to_pivots(q, np.zeros(len(q)), pivots[r["pivot"]][None])[at, 0]
                bound = np.maximum(np.maximum(r["first"] - d, d - r["last"]), 0)
                use = np.flatnonzero((bound > prev) & (bound <= now))
                if not len(use):
                    continue
                ids, labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
                x = np.frombuffer(r["cell_vectors"], kind).reshape(-1, dim).astype(float)
                own = r["cell"] * _WIDE + np.arange(len(ids))
                s = (q @ x.T)[at[use]]
                like = labels[None] == label[use, None]
                fits = (like if same else ~like) & (s >= low[use, None]) & (s <= high[use, None]) & (own[None] != row[use, None])
                s = np.where(fits, s, -np.inf)
                if len(ids) > k:
                    fits &= s >= np.partition(s, -k, axis=1)[:, -k][:, None]
                qi, ci = np.nonzero(fits)
                order = np.lexsort((own[ci], ids[ci], -s[qi, ci], qi))
                qi, ci = qi[order], ci[order]
                first = np.searchsorted(qi, np.arange(len(use)))
                best = np.arange(len(qi)) - first[qi] < k
                qi, ci = qi[best], ci[best]
                yield pa.RecordBatch.from_arrays([pa.array(row[use][qi]), pa.array(slot[use][qi]), pa.array(own[ci]), pa.array(ids[ci]), pa.array(s[qi, ci])], ["row", "slot", "other", "vec_id", "score"])

    return run


_FOUND = "row long, slot int, other long, vec_id long, score double"


def _scanned(index: Index, packs: DataFrame, k: int, same: bool) -> DataFrame:
    deal = F.pmod("cell", F.lit(_SALTS)).cast("int")
    cells = index.cells.select("cell", "pivot", F.col("low").alias("first"), F.col("high").alias("last"), deal.alias("salt"))
    spans = packs.select("pack", F.explode("spans").alias("s")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    spans = spans.select("pack", "salt", "s.*")
    meets = (F.col("last") >= F.col("low")) & (F.col("first") <= F.col("high"))
    seen = (F.col("from") <= F.col("to")) & (F.col("last") >= F.col("from")) & (F.col("first") <= F.col("to"))
    pairs = cells.join(spans, ["pivot", "salt"]).filter(meets & ~seen).select("pack", "cell")
    held = index.cells.select("cell", "pivot", F.col("low").alias("first"), F.col("high").alias("last"), "ids", "labels", F.col("vectors").alias("cell_vectors"))
    work = pairs.join(packs.drop("spans", "anchors"), "pack").join(held, "cell")
    return work.mapInArrow(_scan(index, k, same), _FOUND)


def search(index: Index, queries: DataFrame, k: int, same: bool, folder: str) -> DataFrame:
    """row, slot, rank, vec_id, score: for every query the first k rows of its own label (``same``) or of others.

    ``queries``: row (the query's own row in the index, never a result), slot, label, low
    and high (the scores that it allows), vector; (row, slot) is unique. Higher scores come
    first, ties by vec_id.
    """
    spark, top, kind, start = queries.sparkSession, index.top, index.kind, index.start

    def square(v):
        return float(np.square(np.frombuffer(v, kind).astype(float)).sum())

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sq = np.array([square(v) for v in batch.column(5).to_pylist()])
            low, high = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            limit = np.where(np.isfinite(low), _reach(sq, top, np.where(np.isfinite(low), low, 0)), np.sqrt(sq) + top + 1e-6)
            least = np.where(np.isfinite(high), (_reach(sq, top, np.where(np.isfinite(high), high, 0)) + limit) / 2, start)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sq), pa.array(limit), pa.array(np.full(len(sq), -1.0)), pa.array(np.minimum(least, limit))], ["row", "slot", "label", "low", "high", "vector", "square", "limit", "prev", "now"])

    asked = queries.select("row", "slot", "label", "low", "high", "vector").mapInArrow(begun, "row long, slot int, label long, low double, high double, vector binary, square double, limit double, prev double, now double")
    open_at = f"{folder}/open0"
    waiting = saved(asked, open_at)
    found, found_at, turn = None, None, 0
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "vec_id", "other")
    while not waiting.isEmpty():
        turn += 1
        packs = saved(_packs(index, waiting), f"{folder}/packs{turn}")
        new = _scanned(index, packs, k, same)
        best = (new if found is None else found.unionByName(new)).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
        now_at = f"{folder}/found{turn}"
        found = saved(best, now_at)
        dropped(spark, f"{folder}/packs{turn}", *([found_at] if found_at else []))
        found_at = now_at
        # the distance of the k-th best, where there are k
        have = found.groupBy("row", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k).drop("n")
        at = F.sqrt(F.greatest(F.col("square") + top * top - 2 * F.col("kth"), F.lit(0.0))) * (1 + 1e-9) + 1e-6
        then = waiting.join(have, ["row", "slot"], "left").withColumn("_at", F.when(F.col("kth").isNotNull(), at))
        left = then.filter((F.col("now") < F.col("limit")) & (F.col("_at").isNull() | (F.col("_at") > F.col("now"))))
        wider = F.least("limit", F.coalesce("_at", 2 * F.col("now")))
        # what comes now must beat the k-th best or tie with it
        waiting = left.select("row", "slot", "label", F.coalesce("kth", "low").alias("low"), "high", "vector", "square", "limit", F.col("now").alias("prev"), wider.alias("now"))
        before, open_at = open_at, f"{folder}/open{turn}"
        waiting = saved(waiting, open_at)
        dropped(spark, before)
    if found is None:
        return spark.createDataFrame([], "row long, slot int, rank int, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(order)).select("row", "slot", "rank", "vec_id", "score")


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = LEAST_PERCENT, every: int = ANCHOR_EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, label, embedding).

    Anchors are rows whose vec_id ``every`` divides; a positive is one of an anchor's first rows of
    its label, its negatives are the first rows of other labels that score at most as the
    positive and at least ``percent`` hundredths of it.
    """
    spark = rows.sparkSession
    folder = scratch_dir(spark)
    index = build(rows, folder, positives)
    if index is None:
        return spark.createDataFrame([], _RESULT)
    anchors = saved(members(index, every), f"{folder}/anchors")
    free = [F.lit(x).alias(c) for c, x in (("low", float("-inf")), ("high", float("inf")))]
    near = search(index, anchors.select("row", F.lit(0).alias("slot"), "label", *free, "vector"), positives, True, f"{folder}/positives")
    pairs = saved(near.join(anchors.select("row", F.col("vec_id").alias("anchor_id"), "label", "vector"), "row").select("row", F.col("rank").alias("slot"), "label", "vector", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("high")), f"{folder}/pairs")
    ranges = pairs.withColumn("low", F.ceil(F.col("high") * percent / 100).cast("double")).filter("low <= high")
    hits = search(index, ranges, negatives, False, f"{folder}/negatives")
    named = hits.select("row", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").cast("long").alias("negative_score"))
    return named.join(pairs.select("row", "slot", "anchor_id", "positive_id", F.col("high").cast("long").alias("positive_score")), ["row", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    """The query's labels: (label + 1) % 10 where 7 divides vec_id."""
    return rows.select("vec_id", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"), "embedding")


def op13(rows: DataFrame) -> DataFrame:
    return mine(relabelled(rows))


#: DuckDB SQL for ``op13``: all scores of all anchors.
ORACLE = r"""
with e as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.r, a.vec_id as anchor_id, a.label = b.label as same, b.r as o, b.vec_id as other, cast(list_inner_product(a.v, b.v) as bigint) as score from e a join e b on a.r <> b.r where a.vec_id % 100 = 0
), p as (
  select r, anchor_id, o, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by r order by score desc, other, o) <= 5
)
select p.anchor_id, positive_id, cast(row_number() over w as integer) as rank, other as negative_id, positive_score, score as negative_score
from p join s on s.r = p.r and not same and 80 * positive_score <= 100 * score and score <= positive_score
window w as (partition by p.r, p.o order by score desc, other, s.o) qualify row_number() over w <= 5
"""
