"""Secret scan with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over lower-cased
ASCII trigrams that any match must contain: AND over parts in sequence, OR over
alternatives, and "any" where a part promises nothing. Per block of texts an
inverted index maps every trigram of the rule set to the documents that hold it;
the query's postings are intersected and united, and only the documents left are
searched with the expression itself. Rules whose query is "any" search every text.

Spans are code points, end exclusive. Null texts are empty; empty texts give no
spans. Every input row gives one output row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, text_blocks


@dataclass(frozen=True)
class Rule:
    """``pattern``: over UTF-8 bytes. ``keep``: whether a match counts; those that don't are dropped. ``group``: what of it is the span."""

    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = lambda m: True
    group: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern.encode())


# The three base kinds, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: m.end(2) - m.start(2) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20),
    # runs of 24 and more are the runs of hex digits that count: a run is never split
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
# Publicly documented token shapes.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    # looks from the start of a run of characters at what follows it, then for the first eyJ inside: a long run is read once
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10})[A-Za-z0-9_-]*?(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", group=1),
)

# ---- Boolean trigram queries: None = any, ("tri", bytes), ("and", [..]), ("or", [..])
_MANY = 64


def _and(parts: list) -> tuple | None:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _or(parts: list) -> tuple | None:
    return None if not parts or any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _of_string(s: bytes) -> tuple | None:
    return _and([("tri", s[i : i + 3]) for i in range(len(s) - 2)])


def _exact(node: list) -> list[bytes] | None:
    """All strings (lower-cased) that a parsed sequence can match, or None if too many to list."""
    out = [b""]
    for op, arg in node:
        if op is sre.LITERAL:
            new = [bytes([arg]).lower()] if arg < 256 else None
        elif op is sre.IN:
            new = []
            for kind, a in arg:
                if kind is sre.LITERAL:
                    new.append(bytes([a]).lower())
                elif kind is sre.RANGE and a[1] - a[0] < 8:
                    new += [bytes([c]).lower() for c in range(a[0], a[1] + 1)]
                else:
                    new = None
                    break
            new = sorted(set(new)) if new is not None else None
        elif op is sre.SUBPATTERN:
            new = _exact(list(arg[3]))
        elif op is sre.BRANCH:
            each = [_exact(list(b)) for b in arg[1]]
            new = None if any(e is None for e in each) else [s for e in each for s in e]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 2:
            one = _exact(list(arg[2]))
            new = None if one is None else [b"".join(x) for n in range(arg[0], arg[1] + 1) for x in _power(one, n)]
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            new = [b""]
        else:
            new = None
        if new is None or len(out) * len(new) > _MANY:
            return None
        out = [a + b for a in out for b in new]
    return out


def _power(one: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    out: list[tuple[bytes, ...]] = [()]
    for _ in range(n):
        out = [(*a, b) for a in out for b in one]
    return out


def _query(node: list) -> tuple | None:
    """The trigram query of a parsed sequence: the longest listable runs in a row, and the others' own queries."""
    parts, run = [], []
    for item in [*node, None]:
        if item is not None and _exact([*run, item]) is not None:
            run.append(item)
            continue
        if run:
            parts.append(_or([_of_string(s) for s in _exact(run)]))
        run = []
        if item is None:
            break
        if _exact([item]) is not None:
            run = [item]
            continue
        op, arg = item
        if op is sre.SUBPATTERN:
            parts.append(_query(list(arg[3])))
        elif op is sre.BRANCH:
            parts.append(_or([_query(list(b)) for b in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            parts.append(_query(list(arg[2])))
    return _and(parts)


def trigram_query(pattern: str) -> tuple | None:
    """Boolean trigram query that every match satisfies; None: no trigram is mandatory."""
    return _query(list(sre_parser.parse(pattern.encode())))


def trigrams_of(query: tuple | None) -> set[bytes]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1]))


class TrigramIndex:
    """Inverted index of a block of texts, over the trigrams that a rule set asks for."""

    def __init__(self, data: np.ndarray, docs: np.ndarray, wanted: list[bytes]):
        self.of = {t: i for i, t in enumerate(wanted)}
        low = lower_ascii(data)
        slots = np.zeros(1 << 16, np.uint8)  # a first look at two bytes spares most positions the full one
        for t in wanted:
            slots[t[0] << 8 | t[1]] = 1
        n = len(low)
        hit = np.flatnonzero(slots[low[: n - 1].astype(np.uint16) << 8 | low[1:]][: max(0, n - 2)]) if n > 2 else np.zeros(0, np.int64)
        code = (low[hit].astype(np.int64) << 16) | (low[hit + 1].astype(np.int64) << 8) | low[hit + 2]
        keys = np.array(sorted(t[0] << 16 | t[1] << 8 | t[2] for t in wanted), np.int64)
        number = np.array([self.of[bytes([k >> 16, k >> 8 & 255, k & 255])] for k in keys.tolist()], np.int64)
        at = np.minimum(np.searchsorted(keys, code), max(0, len(keys) - 1))
        ok = keys[at] == code if len(keys) else np.zeros(len(code), bool)
        hit, tri = hit[ok], number[at[ok]]
        doc = np.searchsorted(docs, hit, "right") - 1
        inside = hit + 2 < docs[doc + 1]
        pairs = np.unique(tri[inside] * len(docs) + doc[inside])
        ends = np.searchsorted(pairs, np.arange(len(wanted) + 1) * len(docs))
        self.postings = [pairs[a:b] - i * len(docs) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]

    def candidates(self, query: tuple | None) -> np.ndarray | None:
        """Documents that satisfy the query; None: all."""
        if query is None:
            return None
        if query[0] == "tri":
            return self.postings[self.of[query[1]]]
        parts = [self.candidates(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        out = min(parts, key=len)
        for p in parts:
            out = np.intersect1d(out, p, assume_unique=True)
        return out


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def _scan(rules: tuple[Rule, ...], base: int):
    """The first ``base`` rules are the base kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [r.compiled() for r in rules]
        queries = [trigram_query(r.pattern) for r in rules]
        wanted = sorted(set().union(*map(trigrams_of, queries)))
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for lo, hi, data, docs in text_blocks(batch):
                index = TrigramIndex(data, docs, wanted)
                found: dict[int, list[tuple[int, int, int]]] = {}
                raw = data.tobytes()
                for k, (rule, pattern, query) in enumerate(zip(rules, patterns, queries, strict=True)):
                    rows = index.candidates(query)
                    for d in range(hi - lo) if rows is None else rows.tolist():
                        text = raw[docs[d] : docs[d + 1]]
                        for m in pattern.finditer(text):
                            if rule.keep(m):
                                found.setdefault(d, []).append((m.start(rule.group), k, m.end(rule.group)))
                counts = np.zeros((3, hi - lo), np.int64)
                base_sha, spans, n_spans = [none] * (hi - lo), [""] * (hi - lo), np.zeros(hi - lo, np.int64)
                for d, items in found.items():
                    text = raw[docs[d] : docs[d + 1]]
                    items.sort()
                    if not text.isascii():  # bytes to code points
                        marks = sorted({x for a, _, b in items for x in (a, b)})
                        to, at, chars = {}, 0, 0
                        for x in marks:
                            chars += len(text[at:x].decode("utf-8", "replace"))
                            to[x], at = chars, x
                        items = [(to[a], k, to[b]) for a, k, b in items]
                    names = [f"{rules[k].kind}:{a}:{b}" for a, k, b in items]
                    spans[d], n_spans[d] = ",".join(names), len(names)
                    base_sha[d] = hashlib.sha256(",".join(s for s, (_, k, _) in zip(names, items, strict=True) if k < base).encode()).hexdigest()
                    for _, k, _ in items:
                        if k < 3:
                            counts[k, d] += 1
                ids = batch.column(0).slice(lo, hi - lo).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, counts), pa.array(base_sha), pa.array(spans), pa.array(n_spans)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    return run


def scan(docs: DataFrame, rules: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """Spans of the base kinds and of ``rules`` in every text of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_scan((*BASE_RULES, *rules), len(BASE_RULES)), _SCHEMA)


def op2(docs: DataFrame) -> DataFrame:
    return scan(docs)
