"""Shared pieces of the training-data operators: shared scratch folder, Arrow text access, word hashing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir

#: Bytes of text that a Python worker holds as one block: numpy's arrays over it stay in the cache and in reused memory.
BLOCK_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return shared_dir(spark)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and nothing is computed twice."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete saved tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Tasks to which the rows of a very frequent key are dealt.
SALTS = 32
#: A key with more rows than this, and than one in ``HOT_SHARE`` of all, is very frequent; there are at most ``HOT_SHARE`` such keys.
HOT_ROWS, HOT_SHARE = 256, 2_000
#: Ids that are broadcast at most.
IDS = 1 << 21


def salted(keys: DataFrame, hot: Column) -> DataFrame:
    """``keys`` with a column ``salt``: those that are ``hot`` once for each salt, the others with 0."""
    return keys.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))


def dealt(rows: DataFrame, keys: DataFrame, key: str | list[str], total: int, by: str) -> tuple[DataFrame, DataFrame]:
    """(rows, keys) with a column ``salt``, to be joined on ``key`` and salt without all rows of a frequent key in one task.

    ``keys`` has a column ``rows``, the number of rows of each key out of ``total``; the
    frequent keys are broadcast, ``HOT_SHARE`` at most. ``by`` tells the rows of a key apart.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = keys.filter(F.col("rows") > limit).select(*([key] if isinstance(key, str) else key), F.lit(SALTS).alias("_salts"))
    spread = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_salts")
    return spread, salted(keys, F.col("rows") > limit)


def dealt_ends(pairs: DataFrame, counts: DataFrame, ends: tuple[str, str], total: int, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, items) to be joined twice, on each end's id and salt: ``pairs`` with a salt for each of ``ends``, ``items`` (id, ...) with a column ``salt``.

    As :func:`dealt`, with ``counts`` (second end, rows). Both joins move the items by the same id and salt, so one shuffle serves them.
    """
    a, b = ends
    hot = counts.filter(F.col("rows") > max(HOT_ROWS, total // HOT_SHARE)).select(F.col(b).alias("_id"))
    for end, by in ((a, b), (b, a)):
        told = pairs.join(F.broadcast(hot), F.col(end) == F.col("_id"), "left")
        pairs = told.withColumn(f"salt_{end}", F.when(F.col("_id").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_id")
    return pairs, salted(items.join(F.broadcast(hot), F.col("id") == F.col("_id"), "left"), F.col("_id").isNotNull()).drop("_id")


def among(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` (id, ...) whose id is among ``ids`` (or isn't: left_anti), where they lie if the ids are few enough to be broadcast."""
    few = ids.limit(IDS + 1).count() <= IDS
    return rows.join(F.broadcast(ids) if few else ids, "id", how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_text(col: Column) -> Column:
    return F.crc32(col.cast("string").cast("binary"))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; null ids are not held out."""
    return F.coalesce(F.pmod(crc32_text(doc_id), F.lit(3)) == 1, F.lit(False))


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``limit`` bytes of text (or one document).

    Yields (first row, row after last, bytes as uint8, document offsets into them); null texts are empty.
    """
    col = batch.column(batch.schema.get_field_index(column))
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    n = len(col)
    if not n:
        return
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only, in UTF-8 bytes."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block of texts as 64-bit hashes.

    ``hashes``: one per word in order; ``offsets``: of each document into them.
    ``starts``/``ends``: byte positions in the block.
    """

    def __init__(self, data: np.ndarray, docs: np.ndarray):
        n = len(data)
        white = _WHITE[data]
        black = ~white
        first = black.copy()
        first[1:] &= white[:-1]
        cut = docs[:-1]
        cut = cut[cut < n]
        first[cut] = black[cut]
        self.starts = np.flatnonzero(first)
        # positions in the text without white space: words lie side by side there
        offsets = np.zeros(len(self.starts) + 1, np.int64)
        rank = np.cumsum(black, dtype=np.int64) if n else np.zeros(0, np.int64)
        offsets[:-1] = rank[self.starts] - 1 if len(self.starts) else 0
        offsets[-1] = rank[-1] if n else 0
        self.ends = self.starts + np.diff(offsets)
        packed = data[black]
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        coded = words.dictionary_encode() if len(words) else None
        if coded is None:
            self.hashes = np.zeros(0, np.uint64)
        else:
            self.hashes = hash_strings(coded.dictionary)[coded.indices.to_numpy()]
        self.offsets = np.searchsorted(self.starts, docs)


def hash_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of a binary array's values."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings.to_pylist()), np.uint64, len(strings))


def gram_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-word windows; documents with 1 to n-1 words have their whole sequence as one.

    Returns (hashes, document offsets into them, index of the first word of each).
    """
    count = np.diff(words.offsets)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(size)])
    first = np.repeat(words.offsets[:-1] - offsets[:-1], size) + np.arange(offsets[-1])
    h = words.hashes
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    acc = np.full(len(first), np.uint64(n), np.uint64)
    short = np.repeat(count, size)
    for i in range(n):
        nxt = mix64(acc ^ padded[first + i] + np.uint64(0x9E3779B97F4A7C15))
        acc = np.where(i < short, nxt, acc) if (count < n).any() else nxt
    return acc, offsets, first


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
