"""Benchmark decontamination: rare word-pair seeds that lose nothing, then Smith-Waterman alignment.

Words are lower-cased (A-Z, À-Þ) runs without white space and ASCII punctuation. An item
contaminates a document if their best local alignment on words (match 2, mismatch and
gap -1), divided by the score of the item with itself, is ``LEAST`` or more.

Documents to align are found by a condition that every such alignment meets. With m
matches and x edits it scores 2m - x >= T, and it starts and ends with a match. Of the
m - 1 steps from match to match at most x / 2 hold two edits or more, so ceil(T / 2) - 1
steps at least hold one or none. These join words one or two places apart in the item and
one or two places apart in the document. The alignment covers at most m + x <= 3L - T
words of the document, L being the item's words. So a document is aligned with an item
where ceil(T / 2) - 1 of its places start such a word pair of the item within that many
words, over all the words that such an alignment can reach.

Seeds are the rare ones of these pairs. Steps begin at different words of the item, so if
an item's most common pairs (in the block of texts at hand) begin at fewer of its words
than steps are needed, every alignment also has a step of the others: these are its
seeds. They join documents to items, and only for the documents and items joined are
the common pairs looked at. So nothing is lost, however common all of an item's pairs
are, and scores are those of plain alignment with the whole document.

Items come in blocks of at most ``BLOCK_WORDS`` words and pairs in blocks of about
``BLOCK_HITS`` (or one document's), so what a task holds is bounded, whatever the
benchmark's size. Items with fewer than three words match only as a whole. Null and
empty items and texts match nothing; null ids stay null. Repeated documents are scored
apart; repeated (doc_id, item_id) results are merged to their best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, lower_ascii, text_blocks

LEAST, BLOCK_WORDS, BLOCK_HITS = 0.5, 2_000_000, 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 32


def words_of(data: np.ndarray, docs: np.ndarray) -> Words:
    plain = _PLAIN[lower_ascii(data)]
    latin = (plain[1:] >= 0x80) & (plain[1:] <= 0x9E) & (plain[1:] != 0x97) & (plain[:-1] == 0xC3)
    plain[1:][latin] += 0x20  # À to Þ in UTF-8
    return Words(plain, docs)


def _pair(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of word pairs; ``kind`` 0 for seeds, 1 and 2 for whole items of so many words."""
    return (a * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(kind)) + b


def _shifted(words: np.ndarray, places: int, kind: int) -> np.ndarray:
    return _pair(words[: len(words) - places], words[places:], kind) if len(words) > places else np.zeros(0, np.uint64)


class Items:
    """A block of test items: their words, and the word pairs that occur in them."""

    def __init__(self, texts: list[str], least: float = LEAST):
        raw = [(t or "").encode() for t in texts]
        docs = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
        w = words_of(np.frombuffer(b"".join(raw), np.uint8), docs)
        self.words = [w.hashes[a:b] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
        self.sizes = np.array([len(x) for x in self.words], np.int64)
        score = np.ceil(MATCH * self.sizes * least - 1e-9).astype(np.int64)
        self.need = np.maximum(1, -(-score // 2) - 1)
        self.reach = np.maximum(3 * self.sizes - score, self.sizes)
        #: (places apart, kind) of the pairs to look up in documents
        self.looks = [look for look, any_ in (((0, 1), self.sizes == 1), ((1, 2), self.sizes == 2), ((1, 0), self.sizes > 2), ((2, 0), self.sizes > 2)) if any_.any()]
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pairs = [np.unique(np.concatenate([_shifted(x, places, kind) for places, kind in ([(len(x) - 1, len(x))] if len(x) < 3 else [(1, 0), (2, 0)])]), return_counts=True) if len(x) else none for x in self.words]
        item = np.repeat(np.arange(len(pairs)), [len(k) for k, _ in pairs])
        key, begins = (np.concatenate([none[i], *(p[i] for p in pairs)]) for i in (0, 1))
        order = np.argsort(key, kind="stable")
        self.keys, self.lo = np.unique(key[order], return_index=True)
        self.hi = np.append(self.lo[1:], len(order))
        self.item = item[order]
        #: words of the item at which the pair begins
        self.begins = begins[order]

    def seeds(self, often: np.ndarray) -> np.ndarray:
        """Which of the pairs of each item (as in ``item``) are its seeds, where its key is found ``often``."""
        order = np.lexsort((-np.repeat(often, self.hi - self.lo), self.item))
        item, total = self.item[order], np.cumsum(self.begins[order])
        first = np.searchsorted(item, np.arange(len(self.sizes)))
        before = np.append(0, total)[first]
        seed = np.empty(len(order), bool)
        seed[order] = total - before[item] >= self.need[item]
        return seed

    def screen(self) -> np.ndarray:
        """Which upper 22 bits a pair of the items can have."""
        out = np.zeros(1 << 22, bool)
        out[self.keys >> np.uint64(42)] = True
        return out

    def hits(self, w: Words, screen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, word in it, index into ``keys``) of every pair found, by document."""
        out = []
        for places, kind in self.looks:
            key = _shifted(w.hashes, places, kind)
            word = np.flatnonzero(screen[key >> np.uint64(42)])
            key = key[word]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            doc = np.searchsorted(w.offsets, word, "right") - 1
            hit = (self.keys[at] == key) & (word + places < w.offsets[doc + 1])
            out.append((doc[hit], (word - w.offsets[doc])[hit], at[hit]))
        doc, word, at = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(doc, kind="stable")
        return doc[order], word[order], at[order]


def smith_waterman(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its window, all at once."""
    score = np.zeros(len(items), np.int32)
    size = np.array([len(x) for x in windows], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        ahead = size[order[at : at + 400_000]]
        some = order[at : at + max(1, int(np.searchsorted(ahead * np.arange(1, len(ahead) + 1), 400_000, "right")))]
        at += len(some)
        rows, cols = max(len(items[i]) for i in some), max(len(windows[i]) for i in some)
        a, b = np.zeros((len(some), rows), np.uint64), np.ones((len(some), cols), np.uint64)
        for k, i in enumerate(some):
            a[k, : len(items[i])], b[k, : len(windows[i])] = items[i], windows[i]
        ramp = np.arange(cols + 1, dtype=np.int32) * -GAP
        h = np.zeros((len(some), cols + 1), np.int32)
        best = np.zeros(len(some), np.int32)
        for r in range(rows):
            x = a[:, r : r + 1]
            step = np.where((x == b) & (x > 1), np.int32(MATCH), np.int32(MISMATCH))
            new = np.maximum(h + GAP, 0)
            np.maximum(new[:, 1:], h[:, :-1] + step, out=new[:, 1:])
            h = np.maximum.accumulate(new + ramp, axis=1) - ramp  # gaps along the window
            np.maximum(best, h.max(1), out=best)
        score[some] = best
    return score


def _joined(doc: np.ndarray, word: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, n_items: int) -> np.ndarray:
    """(document * n_items + item) << 32 | word of every pair found and item that has it."""
    n = hi[at] - lo[at]
    each = np.repeat(np.arange(len(at)), n)
    return (doc[each] * n_items + item[np.repeat(lo[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]) << 32 | word[each]


def _stretches(items: Items, seed: np.ndarray, w: Words, doc: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches (document, item, from, to, pairs) that can hold an alignment of enough score."""
    ends = np.append(0, np.cumsum(seed))
    seeded = np.unique(_joined(doc, word, at, ends[items.lo], ends[items.hi], items.item[seed], len(items.sizes)) >> 32)
    use = np.isin(doc, seeded // len(items.sizes))
    both = _joined(doc[use], word[use], at[use], items.lo, items.hi, items.item, len(items.sizes))
    both = np.sort(both[np.isin(both >> 32, seeded)])
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    own, word = both >> 32, both & 0xFFFFFFFF
    item = own % len(items.sizes)
    last = np.arange(len(own)) + items.need[item] - 1
    end = np.minimum(last, len(own) - 1)
    i = np.flatnonzero((last == end) & (own[end] == own) & (word[end] - word <= items.reach[item]))
    own, item, end, reach = own[i], item[i], end[i], items.reach[item[i]]
    doc = own // len(items.sizes)
    a, b = np.maximum(word[end] - reach, 0), np.minimum(word[i] + reach + 2, np.diff(w.offsets)[doc])
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (a[1:] > b[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(own))[: len(start)] - 1
    return doc[start], item[start], a[start], b[stop], end[stop] - i[start] + 1


def _aligned(items: Items, ids: list, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = items.screen()
        for batch in batches:
            key = batch.column(0)
            for lo, hi, data, docs in text_blocks(batch):
                w = words_of(data, docs)
                found = items.hits(w, screen)
                seed = items.seeds(np.bincount(found[2], minlength=len(items.keys)))
                total = np.cumsum(items.hi[found[2]] - items.lo[found[2]])
                at = 0
                while at < len(total):
                    to = int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK_HITS, "right"))
                    if to < len(total):  # only whole documents
                        cut = int(np.searchsorted(found[0], found[0][to]))
                        to = cut if cut > at else int(np.searchsorted(found[0], found[0][at], "right"))
                    doc, item, a, b, n = _stretches(items, seed, w, *(x[at:to] for x in found))
                    at = to
                    if not len(doc):
                        continue
                    base = w.offsets[doc]
                    score = smith_waterman([items.words[i] for i in item], [w.hashes[s + x : s + y] for s, x, y in zip(base.tolist(), a.tolist(), b.tolist(), strict=True)]) / (MATCH * items.sizes[item])
                    hit = score >= least
                    own = key.slice(lo, hi - lo).take(pa.array(doc[hit]))
                    sha = pa.array([hashlib.sha256(data[docs[d] : docs[d + 1]]).hexdigest() for d in doc[hit].tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([own, sha, pa.array([ids[i] for i in item[hit]], pa.int64()), pa.array(score[hit]), pa.array(n[hit]), pa.array(a[hit]), pa.array(b[hit])], ["doc_id", "text_sha256", "item_id", "score", "seeds", "first_word", "last_word"])

    return run


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """The benchmark in blocks of bounded size, one at a time on the driver."""
    ids, texts, n = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        n += r.text.count(" ") + 1
        if n >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _found(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """Every contaminated stretch, with the digest of its row's text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    schema = "doc_id long, text_sha256 string, item_id long, score double, seeds long, first_word long, last_word long"
    found = []
    for ids, texts in _blocks(benchmark):
        items = Items(texts, least)
        if len(items.keys):
            found.append(rows.mapInArrow(_aligned(items, ids, least), schema))
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, found)


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, score, seeds, first_word, last_word of contaminated documents, best stretch of each pair."""
    best = _found(docs, benchmark, least).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "seeds", F.col("first_word").alias("a"), F.col("last_word").alias("b"))).alias("m"))
    return best.select("doc_id", "item_id", "m.score", "m.seeds", F.col("m.a").alias("first_word"), F.col("m.b").alias("last_word"))


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark).withColumn("contaminated", F.lit(True))


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no test item contaminates; columns as given.

    Rows with null or repeated doc_id are told apart by their text's digest, so only contaminated ones go.
    """
    bad = _found(docs, benchmark, LEAST).select(F.col("doc_id").alias("_bad"), F.col("text_sha256").alias("_bad_sha")).distinct()
    sha = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]) & (sha == bad["_bad_sha"]), "left_anti")
