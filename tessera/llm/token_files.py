"""Token-ID output: ids of all documents in ascending doc_id order in compressed, checksummed frames.

``write`` makes a table of frames in the shared folder, ``read`` decodes it again.
A frame holds whole documents of one range of doc_ids, about ``FRAME_IDS`` ids, and
is one Parquet row:

* ``shard``, ``frame``: place in the order; shards are ranges of doc_id;
* ``doc_ids`` (int64), ``doc_lens`` (int64): the frame's documents, little endian;
* ``blocks``: per block three little-endian uint32: ids, payload bytes, crc32 of
  its ids as little-endian uint16;
* ``payload``: the blocks of :mod:`range_coder`, one after the other, each
  decodable alone.

The end id marks no boundary by itself (a text may hold it), so boundaries come
from ``doc_lens``. Null texts are empty; their document is the end id alone. Null
doc_ids sort first. Repeated doc_ids stay separate rows, in any order among
themselves. An empty table makes an empty file and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import range_coder, tokens
from tessera.llm.common import saved, scratch_dir, text_blocks

#: Ids after which a frame is closed.
FRAME_IDS = 8_000_000
END_ID = 2

_SCHEMA = "shard int, frame int, n_docs int, n_ids long, doc_ids binary, doc_lens binary, null_ids binary, blocks binary, payload binary"


class DamagedFile(ValueError):
    """A checksum doesn't match."""


def pack_ids(ids: np.ndarray, block: int = range_coder.BLOCK) -> tuple[bytes, bytes]:
    """(block table, payload) of a run of ids below 65536."""
    if len(ids) and int(ids.max()) > 65535:
        raise ValueError("ids must be below 65536")
    parts = [ids[at : at + block].astype("<u2") for at in range(0, len(ids), block)]
    coded = [range_coder.encode(p) for p in parts]
    head = np.array([(len(p), len(c), zlib.crc32(p.tobytes())) for p, c in zip(parts, coded, strict=True)], "<u4")
    return head.tobytes(), b"".join(coded)


def unpack_ids(blocks: bytes, payload: bytes) -> np.ndarray:
    """The ids of ``pack_ids``; raises DamagedFile where a checksum differs."""
    head = np.frombuffer(blocks, "<u4").reshape(-1, 3).astype(np.int64)
    ends = np.cumsum(head[:, 1])
    if len(payload) != (ends[-1] if len(ends) else 0):
        raise DamagedFile("payload has another length")
    out = []
    for i, ((n, size, crc), end) in enumerate(zip(head.tolist(), ends.tolist(), strict=True)):
        try:
            out.append(range_coder.decode(payload[end - size : end], n))
        except (ValueError, IndexError) as e:
            raise DamagedFile(str(e)) from e
        if zlib.crc32(out[-1].astype("<u2").tobytes()) != crc:
            raise DamagedFile(f"block {i}")
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


def _frames(path: str, end: int, frame_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, shard = 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal held, n, frame
            ids, lens, docs, nulls = (np.concatenate(x) for x in zip(*held, strict=True))
            blocks, payload = pack_ids(ids)
            row = {"shard": shard, "frame": frame, "n_docs": len(docs), "n_ids": len(ids), "doc_ids": docs.astype("<i8").tobytes(), "doc_lens": lens.astype("<i8").tobytes(), "null_ids": nulls.tobytes(), "blocks": blocks, "payload": payload}
            held, n, frame = [], 0, frame + 1
            kinds = {"shard": pa.int32(), "frame": pa.int32(), "n_docs": pa.int32(), "n_ids": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], list(row))

        for batch in batches:
            shard = batch.column(2)[0].as_py() if batch.num_rows else shard
            key = batch.column(0).cast(pa.int64())
            null = key.is_null().to_numpy(zero_copy_only=False)
            key = key.fill_null(0).to_numpy()
            for lo, hi, data, docs in text_blocks(batch, limit=min(frame_ids * 3, tokens.BLOCK_BYTES)):
                ids, off = tokens.append_end(*tokens.encode_block(data, docs, path), end)
                held.append((ids, np.diff(off), key[lo:hi], null[lo:hi].astype(np.uint8)))
                n += len(ids)
                if n >= frame_ids:
                    yield close()
        if held:
            yield close()

    return run


def write(docs: DataFrame, folder: str, vocabulary: str, end: int = END_ID, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text; other columns are ignored) and write the frames to ``folder``."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    frames = ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(_frames(vocabulary, end, frame_ids), _SCHEMA)
    return saved(frames, folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the frames in ``folder``: doc_id, start, n_tokens, ids_crc32, shard, frame, ids (array)."""
    return _read(spark, folder, True)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Like ``read`` without the ids."""
    return _read(spark, folder, False)


def _unpack(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                ids = unpack_ids(f["blocks"], f["payload"])
                lens, docs = np.frombuffer(f["doc_lens"], "<i8"), np.frombuffer(f["doc_ids"], "<i8")
                off = np.concatenate([[0], np.cumsum(lens)])
                if off[-1] != len(ids):
                    raise DamagedFile(f"frame {f['shard']}.{f['frame']}: {off[-1]} ids by document, {len(ids)} in blocks")
                wide = ids.astype("<u4")
                raw = memoryview(wide).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                cols = {
                    "doc_id": pa.array(docs, pa.int64(), mask=np.frombuffer(f["null_ids"], np.uint8).astype(bool)),
                    "start": pa.array(off[:-1] + f["before"]),
                    "n_tokens": pa.array(lens),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "shard": pa.array(np.full(len(docs), f["shard"], np.int32)),
                    "frame": pa.array(np.full(len(docs), f["frame"], np.int32)),
                }
                if whole:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(wide.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def _read(spark: SparkSession, folder: str, whole: bool) -> DataFrame:
    frames = spark.read.parquet(folder)
    # ids before each frame: one short row per shard, then within the shard
    shards = frames.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids")).withColumn("shard_start", F.expr("coalesce(sum(shard_ids) over (order by shard rows between unbounded preceding and 1 preceding), 0)")).drop("shard_ids")
    starts = frames.select("shard", "frame", "n_ids").join(shards, "shard").selectExpr("shard", "frame", "shard_start + coalesce(sum(n_ids) over (partition by shard order by frame rows between unbounded preceding and 1 preceding), 0) as before")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, frame int" + (", ids array<int>" if whole else "")
    return frames.join(starts, ["shard", "frame"]).mapInArrow(_unpack(whole), schema)


def op1(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write all documents as token files and return what reading them back gives."""
    folder = scratch_dir(spark)
    write(docs, folder, vocabulary or tokens.vocabulary_path())
    return digests(spark, folder)
