"""Best-fit packing by linear grouping.

A document's ids with the end id are cut into pieces only where they exceed the
capacity: pieces of exactly the capacity, but for the first, which takes the rest.
Only how many pieces there are of each length matters to the plan, so the plan is
made on the driver from a histogram of at most ``capacity`` numbers, whatever the
input's size:

1. lengths above an eighth of the capacity are large. They are dealt, longest
   first, into ``GROUPS`` groups of equal cardinality and
   rounded up to their group's longest;
2. with these few sizes, the number of sequences of each configuration is
   optimised by linear programming (columns by a knapsack, as in cutting stock) and
   rounded down;
3. actual pieces take the places of their group's size;
4. the large ones left over, and then the small ones, go where they fit best, the
   longest first; new sequences are opened only where none has room.

The plan is a list of runs of sequences with equal contents; a piece finds its place
by its rank among the pieces of its length. Ranks come from per-partition counts.

Null texts are empty: one piece, the end id. Null doc_ids are packed like others;
repeated ids are separate documents. Every piece gets exactly one place. An empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import saved, scratch_dir, text_blocks

CAPACITY, END_ID, GROUPS, LARGE_PART, SLACK = 2048, 0, 128, 8, 5e-4


# ---------------------------------------------------------------- the plan


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(sequences, places of each size) of a linear optimum, rounded down; sizes are distinct and descending."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, value = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    for turn in range(8 * k):  # any stop leaves a feasible basis
        pattern, worth = _knapsack(sizes, inverse.sum(0), capacity)
        if worth <= 1 + SLACK:  # the optimum is at least the value divided by the worth
            break
        step = (inverse * pattern).sum(1)
        ratio = np.where(step > 1e-9, np.maximum(value, 0) / np.where(step > 1e-9, step, 1), np.inf)
        j = int(ratio.argmin())
        basis[:, j] = pattern
        if turn % 50 == 49:
            inverse = _inverse(basis)
        else:  # one column of the basis has changed
            row = inverse[j] / step[j]
            inverse -= np.outer(step, row)
            inverse[j] = row
        value = (inverse * demand).sum(1)
    return [(int(np.floor(v + 1e-6)), basis[:, j].round().astype(np.int64)) for j, v in enumerate(value) if v >= 1]


def _inverse(m: np.ndarray) -> np.ndarray:
    """Gauss-Jordan; threaded linear algebra libraries stall beside a busy JVM."""
    k = len(m)
    a = np.concatenate([m, np.eye(k)], 1)
    for i in range(k):
        p = i + int(np.abs(a[i:, i]).argmax())
        a[[i, p]] = a[[p, i]]
        a[i] /= a[i, i]
        factor = a[:, i].copy()
        factor[i] = 0
        a -= factor[:, None] * a[i]
    return a[:, k:]


def _knapsack(sizes: np.ndarray, dual: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The most valuable set of sizes, each any number of times."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(sizes.min())
    fit = np.searchsorted(-sizes, -np.arange(capacity + 1))  # sizes from here on fit into the room
    for room in range(least, capacity + 1):
        f = fit[room]
        total = best[room - sizes[f:]] + dual[f:]
        i = int(total.argmax())
        if total[i] > best[room - 1]:
            best[room], choice[room] = total[i], i + f
        else:
            best[room] = best[room - 1]
    out, room = np.zeros(len(sizes)), capacity
    while room >= least:
        if choice[room] < 0:
            room -= 1
            continue
        out[choice[room]] += 1
        room -= sizes[choice[room]]
    return out, float(best[capacity])


@dataclass
class _Run:
    """``count`` sequences alike; slots: (length, rank of the first sequence's piece)."""

    count: int
    slots: list[tuple[int, int]]
    room: int

    def split(self, k: int) -> _Run:
        """Take the first ``k`` sequences off."""
        off = _Run(k, list(self.slots), self.room)
        self.count -= k
        self.slots = [(n, r + k) for n, r in self.slots]
        return off


class _Open:
    """Runs by room; finds the tightest that takes a length."""

    def __init__(self, runs: list[_Run]):
        self.by: dict[int, list[_Run]] = {}
        self.rooms: list[int] = []
        for r in runs:
            self.add(r)

    def add(self, run: _Run) -> None:
        if run.room not in self.by:
            self.by[run.room] = []
            bisect.insort(self.rooms, run.room)
        self.by[run.room].append(run)

    def tightest(self, length: int) -> _Run | None:
        i = bisect.bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        run = self.by[room].pop()
        if not self.by[room]:
            del self.by[room]
            self.rooms.pop(i)
        return run

    def all(self) -> list[_Run]:
        return [r for runs in self.by.values() for r in runs]


def _best_fit(open_: _Open, length: int, rank: int, count: int, capacity: int) -> None:
    while count:
        run = open_.tightest(length)
        if run is None:
            each = capacity // length
            full, rest = divmod(count, each)
            for n, per in ((full, each), (1 if rest else 0, rest)):
                if n:
                    open_.add(_Run(n, [(length, rank + i * n) for i in range(per)], capacity - per * length))
                    rank += n * per
            return
        k = min(count, run.count)
        if k < run.count:
            part = run.split(k)
            open_.add(run)
            run = part
        run.slots.append((length, rank))
        run.room -= length
        open_.add(run)
        rank, count = rank + k, count - k


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[_Run]:
    """Runs of sequences that place all pieces; ``counts``: of each length from 1 to ``capacity``."""
    runs = [_Run(counts[capacity], [(capacity, 0)], 0)] if counts.get(capacity) else []
    large = [(n, counts[n]) for n in sorted(counts, reverse=True) if capacity // LARGE_PART < n < capacity and counts[n]]
    total = sum(c for _, c in large)
    groups = max(1, min(groups, total))
    pools: list[list[tuple[int, int, int]]] = []  # per group: (length, first rank, count)
    edges = [round(total * (i + 1) / groups) for i in range(groups)] if total else []
    seen, g = 0, 0
    for length, count in large:
        rank = 0
        while rank < count:
            while g < groups - 1 and seen >= edges[g]:
                g += 1
            while len(pools) <= g:
                pools.append([])
            k = min(count - rank, edges[g] - seen) if g < groups - 1 else count - rank
            pools[g].append((length, rank, k))
            rank, seen = rank + k, seen + k
    pools = [p for p in pools if p]
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for p in pools:  # groups of one size are one
        by_size.setdefault(p[0][0], []).extend(p)
    sizes = np.array(sorted(by_size, reverse=True), np.int64)
    pools = [by_size[s] for s in sizes.tolist()]
    if len(sizes):
        demand = np.array([sum(k for _, _, k in p) for p in pools], float)
        for n, places in _configurations(sizes, demand, capacity):
            want = [i for i, k in enumerate(places.tolist()) for _ in range(k)]
            got = [_take(pools[i], n) for i in want]  # a plan may offer more places than there are pieces
            at = 0
            while at < n:
                here = [next((x for x in g if x[0] <= at < x[0] + x[3]), None) for g in got]
                stop = min([n, *(x[0] + x[3] for x in here if x), *(min((x[0] for x in g if x[0] > at), default=n) for g in got)])
                slots = [(x[1], x[2] + at - x[0]) for x in here if x]
                if slots:
                    runs.append(_Run(stop - at, slots, capacity - sum(s for s, _ in slots)))
                at = stop
    open_ = _Open(runs)
    left = sorted((x for p in pools for x in p if x[2]), reverse=True)
    for length, rank, k in left:
        _best_fit(open_, length, rank, k, capacity)
    for length in sorted((n for n in counts if n <= capacity // LARGE_PART), reverse=True):
        if counts[length]:
            _best_fit(open_, length, 0, counts[length], capacity)
    return open_.all()


def _take(pool: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int, int]]:
    """Up to ``n`` pieces off the pool as (position, length, first rank, count)."""
    out, at = [], 0
    while pool and at < n:
        length, rank, k = pool[0]
        use = min(k, n - at)
        out.append((at, length, rank, use))
        at += use
        if use == k:
            pool.pop(0)
        else:
            pool[0] = (length, rank + use, k - use)
    return out


def places(runs: list[_Run]) -> dict[str, np.ndarray]:
    """Look-up arrays by length and rank: key, sequence of the first piece, offset."""
    rows, base = [], 0
    for run in runs:
        offset = 0
        for length, rank in run.slots:
            rows.append(((length << 44) + rank, base - rank, offset))
            offset += length
        base += run.count
    got = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return {"key": got[:, 0].copy(), "shift": got[:, 1].copy(), "offset": got[:, 2].copy()}


# ---------------------------------------------------------------- on Spark


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            key = batch.column(0)
            for lo, hi, data, docs in text_blocks(batch, limit=tokens.BLOCK_BYTES):
                ids, off = tokens.append_end(*tokens.encode_block(data, docs, path), end)
                n = np.diff(off)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (n - 1) % capacity + 1
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                raw = memoryview(ids.astype("<u4")).cast("B")
                at = off[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                # rank among the partition's pieces of the same length
                order = np.argsort(length, kind="stable")
                s = length[order]
                new = np.flatnonzero(np.diff(s, prepend=-1))
                rank = np.empty(len(s), np.int64)
                rank[order] = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s)))) + counts[s]
                counts += np.bincount(length, minlength=capacity + 1)
                ids_ = key.slice(lo, hi - lo).take(pa.array(doc))
                part = batch.column(1).slice(lo, hi - lo).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids_, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), part, pa.array(rank)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def _placed(table: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(table["key"], (length << 44) + rank, "right") - 1
            cols = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(rank + table["shift"][at]), pa.array(table["offset"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """Per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    folder = scratch_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().alias("part"), F.col("text"))
    made = rows.mapInArrow(_pieces(vocabulary or tokens.vocabulary_path(), end, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")
    pieces = saved(made, f"{folder}/pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = saved(by_part.selectExpr("length", "part", "n", "coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as before"), f"{folder}/before")
    counts = {r.length: r.n for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = places(plan(counts, capacity))
    # the table grows with the partitions and packs well on disk: never broadcast by its file size
    ranked = pieces.join(before.select("length", "part", "before").hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_placed(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5(docs: DataFrame) -> DataFrame:
    return pack(docs)
