"""Exact dedup with a minimal perfect hash over historical distinct digests.

Texts are equal when identical after lower-casing A-Z; null counts as empty. A
history's distinct digests (sha256 of the normalised text) are dealt into shards of
bounded size; each shard is one row with a minimal perfect hash and, per slot, the
full 32-byte digest and the winner's locator (doc_id and row number) with the
group's size. Incoming digests are looked up in their shard: the slot's digest is
compared byte by byte, so a repeat joins the historical group and anything else is
grouped apart. Of equal texts the row with the largest doc_id stays; of rows with
that id too, the one with the largest row number; null ids lose to others.

Hot texts: counts and winners are first gathered per input partition, so a text
reaches its shard at most once per partition, and the verdict goes back to
(text, partition) pairs before rows are joined. Every input row gives one output
row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc32_text, lower_ascii, mix64, saved, scratch_dir, text_blocks

#: Distinct digests that a shard is meant to hold.
SHARD_DIGESTS = 50_000
_LEVELS = 64
#: A column name that no table has.
_OWN = "__tessera_sha256__"


@dataclass
class PerfectHash:
    """Levels of bit arrays: a key's slot is the rank of the first set bit that it meets."""

    bits: list[np.ndarray]  # bool
    ranks: list[np.ndarray]  # set bits before each position, over all levels

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mix64(keys[:, 0] ^ mix64(keys[:, 1] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)))
        return (h % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """``keys``: distinct, (n, 2) uint64. Returns the function and each key's slot."""
        bits, slot, left, base = [], np.full(len(keys), -1), np.arange(len(keys)), 0
        while len(left):
            if len(bits) == _LEVELS:
                raise ValueError("keys aren't distinct")
            size = max(8, 3 * len(left) // 2)
            at = cls._place(keys[left], len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            ok = alone[at]
            rank = np.cumsum(alone) + base - 1
            slot[left[ok]] = rank[at[ok]]
            bits.append(alone)
            base += int(alone.sum())
            left = left[~ok]
        return cls.of_bits(bits), slot

    @classmethod
    def of_bits(cls, bits: list[np.ndarray]) -> PerfectHash:
        ranks, base = [], 0
        for b in bits:
            ranks.append(np.cumsum(b) + base - 1)
            base += int(b.sum())
        return cls(bits, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; any slot, or -1, for keys that weren't there at the build."""
        slot, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (b, r) in enumerate(zip(self.bits, self.ranks, strict=True)):
            if not len(left):
                break
            at = self._place(keys[left], level, len(b))
            hit = b[at]
            slot[left[hit]] = r[at[hit]]
            left = left[~hit]
        return slot

    def to_bytes(self) -> bytes:
        head = np.array([len(self.bits), *map(len, self.bits)], "<u4").tobytes()
        return head + b"".join(np.packbits(b).tobytes() for b in self.bits)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        levels = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes = np.frombuffer(raw, "<u4", levels, 4).astype(int)
        at, bits = 4 + 4 * levels, []
        for n in sizes.tolist():
            bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(bool))
            at += -(-n // 8)
        return cls.of_bits(bits)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, docs in text_blocks(batch):
            raw = memoryview(lower_ascii(data).tobytes())
            out = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(out, pa.binary())], ["doc_id", "row", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own for each row), digest of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text"))
    return rows.mapInArrow(_digests, "doc_id long, row long, digest binary")


def _local(rows: DataFrame) -> DataFrame:
    """Winner and size of each digest within an input partition (the upper bits of ``row``)."""
    part = F.shiftrightunsigned(F.col("row"), 33).cast("int")
    return rows.groupBy("digest", part.alias("part")).agg(F.max(F.struct("doc_id", "row")).alias("win"), F.count(F.lit(1)).alias("n"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digests as bytes (n, 32), doc ids, whether they are null, rows, sizes) of (digest, doc_id, row, n)."""
    raw = b"".join(table["digest"].to_pylist())
    ids = table["doc_id"].combine_chunks()
    return np.frombuffer(raw, np.uint8).reshape(-1, 32), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), table["row"].to_numpy(), table["n"].to_numpy()


def _keys(digest: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digest[:, :16]).view("<u8")


_INDEX = "shard int, function binary, digests binary, doc_ids binary, nulls binary, rows binary, sizes binary"


def _build(key: tuple, table: pa.Table) -> pa.Table:
    digest, ids, null, row, n = _arrays(table)
    function, slot = PerfectHash.build(_keys(digest))
    order = np.empty(len(slot), np.int64)
    order[slot] = np.arange(len(slot))
    cols = [function.to_bytes(), digest[order].tobytes(), ids[order].astype("<i8").tobytes(), null[order].astype(np.uint8).tobytes(), row[order].astype("<i8").tobytes(), n[order].astype("<i8").tobytes()]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], names=[x.split()[0] for x in _INDEX.split(", ")])


def _totals(local: DataFrame) -> DataFrame:
    whole = local.groupBy("digest").agg(F.max("win").alias("win"), F.sum("n").alias("n"))
    return whole.select("digest", "win.doc_id", "win.row", "n")


def build_index(local: DataFrame, shards: int) -> DataFrame:
    """One row per shard of the history's distinct digests, from (digest, part, win, n)."""
    return _totals(local).withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build, _INDEX)


_FOUND = "digest binary, keep_id long, keep_row long, group_size long, known boolean"


def _resolve(index: pa.Table, incoming: pa.Table) -> pa.Table:
    """Groups of the history and of the incoming digests: byte-checked members join, the others stand apart."""
    digest, ids, null, row, n = _arrays(incoming)
    if index.num_rows:
        f = {c: index[c][0].as_py() for c in index.column_names}
        old = np.frombuffer(f["digests"], np.uint8).reshape(-1, 32)
        o_ids, o_row, o_n = (np.frombuffer(f[c], "<i8").copy() for c in ("doc_ids", "rows", "sizes"))
        o_null = np.frombuffer(f["nulls"], np.uint8).astype(bool)
        slot = PerfectHash.from_bytes(f["function"]).slots(_keys(digest)) if len(digest) else np.zeros(0, np.int64)
        member = slot >= 0
        member[member] = (old[slot[member]] == digest[member]).all(1)
        at = slot[member]
        o_n[at] += n[member]
        a = np.stack([~null[member], ids[member], row[member]], 1).astype(np.int64)
        b = np.stack([~o_null[at], o_ids[at], o_row[at]], 1).astype(np.int64)
        wins = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & ((a[:, 1] > b[:, 1]) | ((a[:, 1] == b[:, 1]) & (a[:, 2] > b[:, 2]))))
        hit = at[wins]
        o_ids[hit], o_row[hit], o_null[hit] = ids[member][wins], row[member][wins], null[member][wins]
        rest = ~member
        digest, ids, null, row, n = np.concatenate([old, digest[rest]]), np.concatenate([o_ids, ids[rest]]), np.concatenate([o_null, null[rest]]), np.concatenate([o_row, row[rest]]), np.concatenate([o_n, n[rest]])
        known = np.arange(len(n)) < len(o_n)
    else:
        known = np.zeros(len(n), bool)
    return pa.table([pa.array([d.tobytes() for d in digest], pa.binary()), pa.array(ids, pa.int64(), mask=null), pa.array(row), pa.array(n), pa.array(known)], names=[x.split()[0] for x in _FOUND.split(", ")])


def resolve(index: DataFrame, local: DataFrame, shards: int) -> DataFrame:
    """Per digest of the index and of ``local``: keep_id, keep_row, group_size, known (in the history)."""
    incoming = _totals(local).withColumn("shard", _shard(shards))
    return index.groupBy("shard").cogroup(incoming.groupBy("shard")).applyInArrow(_resolve, _FOUND)


def groups(docs: DataFrame, is_history: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, known of every row of ``docs``.

    ``is_history`` says by doc_id which rows are the history; the others arrive
    later. The result doesn't depend on it, only ``known`` does. By default the
    split is by a bit of the id's crc32.
    """
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession)
    if is_history is None:
        is_history = F.coalesce(F.shiftright(crc32_text(F.col("doc_id")), 7).bitwiseAND(1) == 0, F.lit(True))
    rows = saved(digests(docs), f"{folder}/digests").withColumn("old", is_history)
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_DIGESTS))
    old, new = _local(rows.filter("old")), _local(rows.filter("not old"))
    index = saved(build_index(old, shards), f"{folder}/index")
    found = saved(resolve(index, new, shards), f"{folder}/groups")
    part = F.shiftrightunsigned(F.col("row"), 33).cast("int")
    pairs = rows.select("digest", part.alias("part")).distinct().join(found, "digest")
    out = rows.withColumn("part", part).join(pairs, ["digest", "part"])
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "known")


def op6(docs: DataFrame) -> DataFrame:
    return groups(docs).drop("known")


def deduped(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns as given."""
    stay = saved(groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")), f"{scratch_dir(docs.sparkSession)}/kept")
    repeated = stay.groupBy("_id").count().filter("count > 1").limit(1).count() > 0
    same = docs["doc_id"].cast("long").eqNullSafe(stay["_id"])
    if not repeated:
        out = docs.join(stay, same, "left_semi")
        # an id may also stand on rows whose text goes
        twice = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
        if not twice:
            return out
    sha = F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    out = docs.withColumn(_OWN, sha)
    same = out["doc_id"].cast("long").eqNullSafe(stay["_id"])
    return out.join(stay, same & (out[_OWN] == stay["_sha"]), "left_semi").dropDuplicates(["doc_id", _OWN]).drop(_OWN)


#: DuckDB SQL for ``op6`` by definition, without the column that tells of the history.
ORACLE = """
with t as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents
), g as (
  select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by 1
)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
"""
