"""A learned text encoder: latent semantic vectors by a distributed randomised SVD.

Words are hashed into ``BUCKETS`` features, weighted by (1 + ln tf) idf and scaled to unit
length; that sparse matrix is written once, in blocks of texts. Subspace iteration finds its
leading right singular vectors: from a random start G, every pass multiplies each row with G
and adds the row times that product to the task's own sum (A'A G without forming A'A), the
tasks' sums are added by feature, and the driver orthogonalises the result. A pass runs in
``TASKS`` tasks a core whatever the corpus, as each task's sum is of the model's size. What reaches the
driver and is sent back is BUCKETS x (dim + EXTRA) numbers at most, whatever the corpus. The
last pass gives the small matrix G'A'A G, whose eigenvectors turn G into singular vectors; the
sign of each makes its largest component positive, so a model doesn't depend on the start's.

Null and empty texts and texts without words are the zero vector.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.encoding import pieces
from tessera.session import shared_dir

#: Features, components beyond those that are kept, passes, numbers of a task's sum that leave it at once, tasks of a pass for each core.
BUCKETS, EXTRA, PASSES, BLOCK_FLOATS, TASKS = 1 << 15, 16, 6, 1 << 17, 2
_BLOCK = "sizes binary, at binary, n binary"


class Model(NamedTuple):
    idf: np.ndarray  # of each feature
    vectors: np.ndarray  # features x dim, orthonormal columns
    values: np.ndarray  # singular values, falling


def _counts(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    words = re.findall(r"\w+", (text or "").lower())
    return np.unique(np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)) % np.uint32(buckets), return_counts=True)


def counts(text: str | None, buckets: int = BUCKETS) -> tuple[list[int], list[int]]:
    """(features, how often) of a text's words."""
    at, n = _counts(text, buckets)
    return at.tolist(), n.tolist()


def weighted(at: list[int] | np.ndarray, n: list[int] | np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of unit length."""
    w = (1 + np.log(np.asarray(n, float))) * idf[at]
    norm = np.linalg.norm(w)
    return w / norm if norm else w


def rows(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """sizes, at, n (int32 each): the features of the texts that have a word and how often they are there, a piece of a batch in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, m in pieces(batch.column(0)):
                found = [x for x in (_counts(t, buckets) for t in batch.column(0).slice(i, m).to_pylist()) if len(x[0])]
                if found:
                    blobs = ([len(at) for at, _ in found], np.concatenate([at for at, _ in found]), np.concatenate([n for _, n in found]))
                    yield pa.RecordBatch.from_arrays([pa.array([np.asarray(x, np.int32).tobytes()], pa.binary()) for x in blobs], ["sizes", "at", "n"])

    return docs.select("text").mapInArrow(run, _BLOCK)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield tuple(np.frombuffer(x.as_buffer(), np.int32) for x in row)


def document_frequencies(sparse: DataFrame, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(documents with words, idf of every feature) of :func:`rows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(buckets, np.int64), 0
        for sizes, features, _ in _blocks(batches):
            df += np.bincount(features, minlength=buckets)
            n += len(sizes)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])

    got = sparse.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    total = int(n[at == -1].sum())
    df = np.zeros(buckets)
    df[at[at >= 0]] = n[at >= 0]
    return total, np.log((1 + total) / (1 + df)) + 1


def _added(sparse: DataFrame, idf: np.ndarray, g: np.ndarray) -> np.ndarray:
    """A'A g, summed over the tasks by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(g)
        for sizes, features, n in _blocks(batches):
            ends = np.cumsum(sizes)
            weights = (1 + np.log(n)) * idf[features]
            weights /= np.repeat(np.sqrt(np.add.reduceat(np.square(weights), ends - sizes)), sizes)
            for i, j in zip(ends - sizes, ends, strict=True):
                at, w = features[i:j], weights[i:j]  # a row's features are distinct
                total[at] += np.multiply.outer(w, w @ g[at])
        at = np.flatnonzero(total.any(1))
        step = max(1, BLOCK_FLOATS // g.shape[1])
        for i in range(0, len(at), step):
            some = at[i : i + step]
            offsets = np.arange(len(some) + 1, dtype=np.int32) * g.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(pa.array(offsets), pa.array(total[some].ravel()))], ["bucket", "part"])

    tasks = TASKS * sparse.sparkSession.sparkContext.defaultParallelism
    parts = sparse.coalesce(tasks).mapInArrow(run, "bucket long, part array<double>")
    summed = parts.groupBy("bucket").agg(*(F.sum(F.col("part")[j]).alias(f"p{j}") for j in range(g.shape[1]))).toArrow()
    out = np.zeros_like(g)
    if summed.num_rows:
        out[summed.column(0).to_numpy()] = np.column_stack([summed.column(j + 1).to_numpy() for j in range(g.shape[1])])
    return out


def fit(docs: DataFrame, dim: int, passes: int = PASSES, buckets: int = BUCKETS) -> Model | None:
    """The model of (doc_id, text); None where no text has a word. Fewer dimensions than ``dim`` where the matrix has a smaller rank."""
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/rows"
    rows(docs, buckets).write.parquet(path)
    sparse = spark.read.schema(_BLOCK).parquet(path)
    total, idf = document_frequencies(sparse, buckets)
    if not total:
        return None
    g = np.linalg.qr(np.random.default_rng(11).normal(size=(buckets, min(dim + EXTRA, buckets))))[0]
    for _ in range(passes):
        g = np.linalg.qr(_added(sparse, idf, g))[0]
    values, turn = np.linalg.eigh(g.T @ _added(sparse, idf, g))
    order = np.argsort(-values)[:dim]
    order = order[values[order] > 1e-9 * values.max()]
    vectors = g @ turn[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return Model(idf, vectors, np.sqrt(values[order]))


def encode(model: Model) -> Callable[[list[str]], np.ndarray]:
    """A function of texts to unit vectors, for ``encoding.encoder``."""
    idf, vectors = model.idf, model.vectors.astype(np.float32)

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), vectors.shape[1]), np.float32)
        for row, text in zip(out, texts, strict=True):
            at, n = _counts(text, len(idf))
            if len(at):
                v = weighted(at, n, idf) @ vectors[at]
                row += v / (np.linalg.norm(v) or 1)
        return out

    return run
