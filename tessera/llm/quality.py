"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns a text into ``FEATURES`` numbers (shares of byte classes, word
and line repetition, sizes). ``train`` fits trees of fixed depth by histograms of
at most ``BINS`` quantile bins; ``Trees`` keeps every tree as a complete binary
tree in flat arrays, and numpy walks all documents of a block down a tree at once.

The fit uses at most ``SAMPLE_ROWS`` labelled rows, those first by a hash of
doc_id; everything is scored. Null and empty texts have all statistics 0 and are
scored like others. Labelled ids without a document, and null labels, are ignored;
of repeated labels of an id the largest counts. With no labels, or one class only,
the score is that class's share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, is_held_out, text_blocks

#: Labelled rows that the fit uses at most.
SAMPLE_ROWS = 20_000
BINS, DEPTH, TREES, RATE, L2 = 64, 4, 60, 0.2, 1.0

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "stop", "mark", "symbol", "wide", "white", "lines", "upper_words", "marked_words", "lone_marks", "distinct", "repeats", "line_repeats", "top_word", "stretch")

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 sentence mark, 4 ! or ?, 5 other visible ASCII mark, 6 beyond ASCII, 7 white, 8 lower
_CLASS[65:91], _CLASS[48:58], _CLASS[97:123] = 1, 2, 8
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 3
_CLASS[[ord("!"), ord("?")]] = 4
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()!?"]] = 5
_CLASS[128:] = 6
_CLASS[[9, 10, 11, 12, 13, 32]] = 7


def _per_doc(mask: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[docs]).astype(float)


def statistics(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """(documents, features) of a block of texts."""
    n_docs = len(docs) - 1
    size = np.diff(docs).astype(float)
    kind = _CLASS[data]
    some = np.maximum(size, 1)
    share = {k: _per_doc(kind == k, docs) / some for k in range(1, 9)}
    words = Words(data, docs)
    n_words = np.diff(words.offsets).astype(float)
    each = np.maximum(n_words, 1)
    letters = np.concatenate([[0], np.cumsum((kind == 8) | (kind == 6), dtype=np.int64)])
    caps = np.concatenate([[0], np.cumsum(kind == 1, dtype=np.int64)])
    marks = np.concatenate([[0], np.cumsum((kind == 5) | (kind == 4), dtype=np.int64)])
    s, e = words.starts, words.ends
    is_upper = (caps[e] - caps[s] >= 2) & (letters[e] - letters[s] <= 1)
    has_mark = marks[e] - marks[s] > 0
    lone = marks[e] - marks[s] == e - s
    off = words.offsets
    distinct, top, same, line_same, stretch = (np.zeros(n_docs) for _ in range(5))
    again = np.zeros(len(words.hashes), bool)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    starts = off[:-1][n_words > 0]
    again[starts] = False
    same = _per_doc(again, off) / each
    newline = np.flatnonzero(data == 10)
    line_at = np.searchsorted(newline, docs)
    for d in np.flatnonzero(n_words > 1).tolist():
        _, count = np.unique(words.hashes[off[d] : off[d + 1]], return_counts=True)
        distinct[d] = len(count) / n_words[d]
        top[d] = count.max() / n_words[d]
        if line_at[d + 1] - line_at[d] > 0:
            lines = data[docs[d] : docs[d + 1]].tobytes().split(b"\n")
            line_same[d] = 1 - len(set(lines)) / len(lines)
            stretch[d] = max(map(len, lines)) / size[d]
        else:
            stretch[d] = 1
    one = n_words == 1
    distinct[one], top[one], stretch[one] = 1, 1, 1
    return np.stack([np.log1p(size), np.log1p(n_words), size / each, share[1], share[2], share[3], share[4], share[5], share[6], share[7], _per_doc(data == 10, docs) / some, _per_doc(is_upper, off) / each, _per_doc(has_mark, off) / each, _per_doc(lone, off) / each, distinct, same, line_same, top, stretch], 1)


@dataclass
class Trees:
    """Complete trees in flat arrays: inner nodes level by level, then 2**depth leaves."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # the same shape; right if the value is larger
    leaf: np.ndarray  # (trees, 2**depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Second-order boosting of the logistic loss on binned features."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        p = min(max(p, 1e-6), 1 - 1e-6)
        return Trees(float(np.log(p / (1 - p))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = node - first
            best, best_f, best_b = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, -1)
            for f in range(x.shape[1]):
                key = at * bins + binned[:, f]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[:, len(edges[f]) :] = -1  # no edge there
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = -1
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                better = top > best
                best, best_f, best_b = np.where(better, top, best), np.where(better, f, best_f), np.where(better, b, best_b)
            split = best_b >= 0
            out.feature[t, first : first + width] = best_f
            out.threshold[t, first : first + width] = [edges[f][b] if s else np.inf for f, b, s in zip(best_f, best_b, split, strict=True)]
            right = split[at] & (binned[np.arange(len(y)), best_f[at]] > best_b[at])
            node = 2 * node + 1 + right
        at = node - inner
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        out.leaf[t] = -rate * gs / (hs + L2)
        total += out.leaf[t][at]
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label, text -> doc_id, label, x."""
    for batch in batches:
        for lo, hi, data, docs in text_blocks(batch):
            x = statistics(data, docs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists], ["doc_id", "label", "x"])


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "quality") -> pd.DataFrame:
    """Features of at most ``rows`` labelled documents that aren't held out, as pandas."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy(doc_id.alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    found = chosen.join(docs.select(doc_id.alias("doc_id")).distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    few = spark.createDataFrame(found, "doc_id long, label int")
    got = docs.select(doc_id.alias("doc_id"), F.col("text")).join(F.broadcast(few), "doc_id").select("doc_id", "label", "text")
    return got.mapInArrow(_features, "doc_id long, label int, x array<double>").toPandas()


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    got = sample(docs, labels, rows).sort_values(["doc_id"], kind="stable").head(rows)
    x = np.array(got.x.tolist(), float).reshape(len(got), len(FEATURES))
    return train(x, got.label.to_numpy(float))


def _scores(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, docs in text_blocks(batch):
                p = trees.score(statistics(data, docs))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text")).mapInArrow(_scores(trees), "doc_id long, held_out boolean, score double, predicted int")


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
