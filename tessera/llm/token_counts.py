"""Token counts by a separator scan over flat token files.

A flat file is nothing but token ids, little-endian uint16, documents ended by the
end id and no index. ``write_flat`` stores each shard's stream as consecutive raw
blocks of ``BLOCK_IDS`` ids; documents run across blocks. ``count`` finds the end
ids of each block with one vectorised comparison; a prefix scan over the blocks'
summaries (ids, end ids, place of the last end id) stitches the documents that
cross blocks. ``flat_files`` reads the same bytes from plain files.

The end id must not occur in a text's own ids, so it lies above the vocabulary
(65535; a text may hold the string of the vocabulary's own end token, which then
counts as one id). Ids after a file's last
end id are an unfinished document: it gets a row with ``ended`` false. Null and
empty texts count 0 ids. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import saved, scratch_dir, text_blocks

#: Ids in a block.
BLOCK_IDS = 1 << 19
END_ID = 65535


def _blocks(path: str, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs_of, null_of, number, shard, n = [], [], [], 0, 0, 0

        def row(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal number, docs_of, null_of
            docs = np.concatenate(docs_of) if docs_of else np.zeros(0, np.int64)
            null = np.concatenate(null_of) if null_of else np.zeros(0, bool)
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([ids.astype("<u2").tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), pa.array(docs, pa.int64(), mask=null))], ["shard", "block", "data", "doc_ids"])
            docs_of, null_of, number = [], [], number + 1
            return out

        for batch in batches:
            shard = batch.column(2)[0].as_py() if batch.num_rows else shard
            key = batch.column(0)
            null = key.is_null().to_numpy(zero_copy_only=False)
            key = key.fill_null(0).to_numpy()
            for lo, hi, data, docs in text_blocks(batch, limit=tokens.BLOCK_BYTES):
                ids, _ = tokens.append_end(*tokens.encode_block(data, docs, path), end)
                docs_of.append(key[lo:hi])
                null_of.append(null[lo:hi])
                held.append(ids)
                n += len(ids)
                if n >= block:
                    joined = np.concatenate(held)
                    for at in range(0, n - block + 1, block):
                        yield row(joined[at : at + block])
                    held = [joined[n - n % block :]]
                    n %= block
        if n or docs_of:
            yield row(np.concatenate(held))

    return run


def write_flat(docs: DataFrame, folder: str, vocabulary: str, end: int = END_ID, block: int = BLOCK_IDS) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text); ``doc_ids`` lists the documents in order, without places.

    A shard is an input partition in its own order, so nothing is shuffled.
    """
    if tokens.load(vocabulary).get_vocab_size() > end:
        raise ValueError("the end id is one of the vocabulary's")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.spark_partition_id().alias("shard")).mapInArrow(_blocks(vocabulary, end, block), "shard int, block int, data binary, doc_ids array<long>")
    return saved(rows, folder)


def _cut_files(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()
                for i, at in enumerate(range(0, len(raw), 2 * block)):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([i], pa.int32()), pa.array([raw[at : at + 2 * block].to_pybytes()], pa.binary())], ["shard", "block", "data"])

    return run


def flat_files(spark: SparkSession, path: str, block: int = BLOCK_IDS) -> DataFrame:
    """Plain files of uint16 ids (under 2 GB each) as blocks; ``shard`` is the file's path."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_cut_files(block), "shard string, block int, data binary")


def _ends(end: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(data.as_buffer(), "<u2")
                ends = np.flatnonzero(ids == end).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([shard], kind), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends))], ["shard", "block", "n", "ends"])

    return run


def count(blocks: DataFrame, end: int = END_ID) -> DataFrame:
    """Per document of flat ``blocks`` (shard, block, data): shard, ordinal in the shard, start and n_tokens (without the end id), ended."""
    kind = blocks.schema["shard"].dataType.simpleString()
    found = blocks.select("shard", "block", "data").mapInArrow(_ends(end, pa.string() if kind == "string" else pa.int32()), f"shard {kind}, block int, n long, ends array<int>")
    # the prefix scan: per block the ids and end ids before it, and the place after the last end id before it
    over = "(partition by shard order by block rows between unbounded preceding and 1 preceding)"
    based = found.selectExpr("*", f"coalesce(sum(n) over {over}, 0) as base", f"coalesce(sum(size(ends)) over {over}, 0) as docs_before")
    opened = based.selectExpr("*", "case when size(ends) > 0 then base + element_at(ends, -1) + 1 end as after_last")
    opened = opened.selectExpr("shard", "block", "n", "ends", "base", "docs_before", f"coalesce(max(after_last) over {over}, 0) as open_at", "max(block) over (partition by shard) as last_block")
    ended = opened.selectExpr("shard", "base", "docs_before", "open_at", "ends", "posexplode(ends) as (i, e)").selectExpr("shard", "docs_before + i as ordinal", "case when i = 0 then open_at else base + ends[i - 1] + 1 end as start", "base + e as stop", "true as ended")
    rest = opened.filter("block = last_block").selectExpr("shard", "docs_before + size(ends) as ordinal", "case when size(ends) > 0 then base + element_at(ends, -1) + 1 else open_at end as start", "base + n as stop", "false as ended").filter("stop > start")
    return ended.unionByName(rest).selectExpr("shard", "cast(ordinal as long) as ordinal", "cast(start as long) as start", "cast(stop - start as long) as n_tokens", "ended")


def op3(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Token counts of all documents, counted in flat files written from them."""
    blocks = write_flat(docs, scratch_dir(spark), vocabulary or tokens.vocabulary_path())
    over = "(partition by shard order by block rows between unbounded preceding and 1 preceding)"
    names = blocks.selectExpr("shard", "block", "doc_ids", f"coalesce(sum(size(doc_ids)) over {over}, 0) as first").selectExpr("shard", "first", "posexplode(doc_ids) as (i, doc_id)").selectExpr("shard", "first + i as ordinal", "doc_id")
    return count(blocks).join(names, ["shard", "ordinal"]).select("doc_id", "n_tokens", "shard", "ordinal", "start", "ended")
