"""Exact byte-level BPE ids of many texts with the tokenizers library.

The vocabulary's pre-tokenizer never carries a piece over certain places: before a
space that a visible character follows, after a single newline between visible
characters, and between a Latin letter and an ASCII mark or digit. Texts are cut there, each distinct piece of a block goes through the
library once, and its ids are put in place for every occurrence. A worker remembers
the ids of the first ``KNOWN_PIECES`` pieces that it meets.

The strings of the vocabulary's own tokens (``<|endoftext|>``) become their ids wherever they stand
in a text, as the library does it by default.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded as one block: the more, the more often a piece repeats.
BLOCK_BYTES = 16 << 20
#: Pieces that a worker remembers.
KNOWN_PIECES = 300_000

_SEEN = np.zeros(256, bool)  # bytes that begin no white space
_SEEN[0x21:0x7F] = True
_SEEN[[0xC3, *range(0xC4, 0xE0), 0xE0, *range(0xE4, 0xF5)]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalpha()]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91], _ALPHA[97:123] = True, True
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(2)
def _own_strings(path: str) -> re.Pattern | None:
    """The strings that the vocabulary takes out of a text before anything else."""
    own = list(load(path).get_added_tokens_decoder().values())
    if any(t.lstrip or t.rstrip or t.single_word for t in own):
        raise ValueError("tokens that take neighbouring white space or stand only between words are not supported")
    return re.compile(b"|".join(re.escape(t.content.encode()) for t in sorted(own, key=lambda t: -len(t.content)))) if own else None


def own_places(data: np.ndarray, docs: np.ndarray, path: str) -> np.ndarray:
    """(k, 2) bytes from and to of the vocabulary's own strings in a block's texts."""
    pattern = _own_strings(path)
    found = [m.span() for m in pattern.finditer(memoryview(np.ascontiguousarray(data)))] if pattern else []
    spans = np.array(found, np.int64).reshape(-1, 2)
    return spans[np.searchsorted(docs, spans[:, 0], "right") == np.searchsorted(docs, spans[:, 1] - 1, "right")]


def cut_places(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Sorted byte positions at which the pieces of a block of texts begin."""
    n = len(data)
    seen = np.zeros(n, bool)  # the next byte is of the same document and begins a visible character
    seen[:-1] = _SEEN[data[1:]]
    ends = docs[1:] - 1
    seen[ends[ends >= 0]] = False
    cut = (data == 32) & seen
    line = (data == 10) & seen
    line[1:] &= _PLAIN[data[:-1]]
    at = np.flatnonzero(line)
    cut[at[at > 0] + 1] = True
    # a letter's run ends before an ASCII mark or digit
    mark = np.flatnonzero(_MARK[data[1:]] & ~_MARK[data[:-1]]) + 1
    last = data[mark - 1]
    wide = (data[np.maximum(mark - 2, 0)] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (mark > 1)
    cut[mark[_ALPHA[last] | wide]] = True
    starts = docs[:-1]
    cut[starts[starts < n]] = True
    return np.flatnonzero(cut)


@functools.lru_cache(2)
def _id_bytes(path: str) -> np.ndarray:
    """Bytes of text behind each id: a byte-level vocabulary writes each byte as one character."""
    t = load(path)
    return np.array([len(t.id_to_token(i) or "") for i in range(t.get_vocab_size())], np.int64)


def _encode_distinct(pieces: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces in order, number of ids of each).

    Pieces that begin with a space and a visible character are encoded side by side
    as one long text: a cut is safe before each of them, and the bytes of the ids
    tell where each ends. The others are encoded one by one.
    """
    tok, size = load(path), np.diff(np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1])
    raw = np.frombuffer(pieces.buffers()[2], np.uint8)
    at = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces)]
    joined = (size > 1) & (raw[at] == 32)
    joined[joined] = _SEEN[raw[at[joined] + 1]]
    sizes = np.zeros(len(pieces), np.int64)
    ids: list[np.ndarray] = [np.zeros(0, np.uint32)]
    order: list[np.ndarray] = [np.zeros(0, np.int64)]
    which = np.flatnonzero(joined)
    texts = pieces.take(pa.array(which)).cast(pa.large_string())
    for lo in range(0, len(which), 5_000):
        part = which[lo : lo + 5_000]
        got = np.array(tok.encode_batch_fast(["".join(texts[lo : lo + 5_000].to_pylist())], add_special_tokens=False)[0].ids, np.uint32)
        ends, wanted = np.cumsum(_id_bytes(path)[got]), np.cumsum(size[part])
        place = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[place], wanted):
            raise ValueError("the vocabulary carries a piece over a cut; it isn't a byte-level one of the expected kind")
        sizes[part] = np.diff(place + 1, prepend=0)
        ids.append(got)
        order.append(part)
    which = np.flatnonzero(~joined)
    for lo in range(0, len(which), 20_000):
        part = which[lo : lo + 20_000]
        flat: list[int] = []
        for i, e in zip(part, tok.encode_batch_fast(pieces.take(pa.array(part)).cast(pa.large_string()).to_pylist(), add_special_tokens=False), strict=True):
            one = e.ids
            sizes[i] = len(one)
            flat += one
        ids.append(np.array(flat, np.uint32))
        order.append(part)
    order_all = np.concatenate(order)
    ends = np.cumsum(sizes)
    n = sizes[order_all]
    out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
    out[np.repeat((ends - sizes)[order_all] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.concatenate(ids)
    return out, sizes


class _Known:
    """Pieces and their ids."""

    def __init__(self):
        self.pieces, self.sizes, self.ids = pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, pieces: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        n = max(0, min(len(pieces), KNOWN_PIECES - len(self.pieces)))
        if n:
            self.pieces = pa.concat_arrays([self.pieces, pieces.slice(0, n)])
            self.sizes = np.append(self.sizes, sizes[:n])
            self.ids = np.append(self.ids, ids[: int(sizes[:n].sum())])


@functools.lru_cache(2)
def _known(path: str) -> _Known:
    return _Known()


def _encode_pieces(pieces: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, where the ids of each piece begin among them, their number)."""
    known = _known(path)
    at = pc.fill_null(pc.index_in(pieces, value_set=known.pieces), -1).to_numpy().astype(np.int64)
    new = np.flatnonzero(at < 0)
    fresh = pieces.take(pa.array(new))
    ids, sizes = _encode_distinct(fresh, path)
    all_sizes = np.append(known.sizes, sizes)
    starts = np.cumsum(all_sizes) - all_sizes
    at[new] = len(known.sizes) + np.arange(len(new))
    source = np.append(known.ids, ids)
    known.add(fresh, sizes, ids)
    return source, starts[at], all_sizes[at]


def encode_block(data: np.ndarray, docs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents, document offsets into them) of a block of UTF-8 texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(len(docs), np.int64)
    own = own_places(data, docs, path)
    cuts = cut_places(data, np.union1d(docs, own) if len(own) else docs)
    if len(own):
        i = np.searchsorted(own[:, 0], cuts, "left") - 1  # the last own string that begins before the cut
        cuts = cuts[(i < 0) | (cuts >= own[np.maximum(i, 0), 1])]
    offsets = np.append(cuts, n).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    source, where, sizes = _encode_pieces(coded.dictionary, path)
    index = coded.indices.to_numpy()
    size = sizes[index]
    out = np.concatenate([[0], np.cumsum(size)])
    ids = source[np.repeat(where[index] - out[:-1], size) + np.arange(out[-1])]
    return ids, out[np.searchsorted(cuts, docs)]


def append_end(ids: np.ndarray, docs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each document's."""
    new = docs + np.arange(len(docs))
    out = np.full(new[-1], end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[new[1:] - 1] = False
    out[keep] = ids
    return out, new
