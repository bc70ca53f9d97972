"""Text encoders: an Arrow-batched hashing encoder by default; any function of texts to unit vectors fits."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 384
#: Texts and bytes of them that are worked on at once; a longer text is alone.
ROWS, BYTES = 512, 1 << 20


def hashing(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Unit vectors of hashed words and word pairs; a text without words is the zero vector."""
    out = np.zeros((len(texts), dim), np.float32)
    known: dict[str, int] = {}
    for row, text in zip(out, texts, strict=True):
        words = re.findall(r"\w+", (text or "").lower())
        for w in words:
            if w not in known:
                known[w] = zlib.crc32(w.encode())
        one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
        h = np.concatenate([one, two])
        row += np.bincount((h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(31), 1.0, -1.0), dim)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of ``texts`` within ``ROWS`` and ``BYTES``, so that memory doesn't grow with an Arrow batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        most = (ends[i - 1] if i else 0) + BYTES
        j = min(max(i + 1, int(np.searchsorted(ends, most, "right"))), i + ROWS, len(texts))
        yield i, j - i
        i = j


def encoder(encode: Callable[[list[str]], np.ndarray] = hashing) -> Callable[[Column], Column]:
    """An Arrow UDF around ``encode``, which gets bounded pieces of a batch; the model is made once per worker by whatever ``encode`` holds."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for i, n in pieces(texts):
                v = np.asarray(encode(texts.slice(i, n).to_pylist()), np.float32)
                yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))

    return F.arrow_udf(run, T.ArrayType(T.FloatType()))
