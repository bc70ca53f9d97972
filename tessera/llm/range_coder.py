"""Adaptive context-mixing range coder for token ids, many parts of a block in lock step.

A block is coded on its own from an empty model. It is cut into equal parts, its lanes, which
numpy codes side by side, one id of each per step; every lane is a range coder of its own, and
all share the block's model. At fixed steps the model is counted anew from all ids that the
block's lanes have coded so far, which the decoder has by then too:

* order 2: for (hashes of) pairs of preceding ids the id that most often followed, and how sure it is;
* order 1: the same for the preceding id;
* order 0: how often each id occurred.

How sure an id is: its count over the context's count plus one, in seven levels. The three are
mixed with weights learned from the block itself, one set for each pair of levels:
p(id) = w2 [id = order 2's] + w1 [id = order 1's] + w0 count(id) / n + w (uniform over 16 bits).
The term that holds the id is coded first, then, where needed, the id within the term.

The coder's state is in whole doubles below 2^53, in which all its steps are exact.
"""

from __future__ import annotations

import numpy as np

#: Ids in a block; ids are below 65536.
BLOCK = 1 << 20
#: Lanes of a block at most, and ids that a lane has at least.
LANES, LEAST_STEPS = 4096, 256
#: Steps at which the model is counted anew.
REFRESH = (2, 8, 32, 128)
#: Steps whose terms are looked up together.
_CHUNK = 16
_BITS2 = 18
_SHARES = np.array([0.15, 0.3, 0.45, 0.6, 0.75, 0.9])
_UNIT, _TOP, _BOTTOM = 4096.0, 2.0**48, 2.0**32
_STATES = 128


def shape(n: int) -> tuple[int, int]:
    """(lanes, steps) of a block of ``n`` ids."""
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    return lanes, -(-n // lanes)


def _hash2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint32) * np.uint32(2654435761) ^ b.astype(np.uint32) * np.uint32(2246822519)) >> np.uint32(32 - _BITS2)


def _followers(context: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    """By context: its most frequent follower, with the level of its share above bit 16; 0 for contexts without one."""
    out = np.zeros(1 << bits, np.uint32)
    if not len(x):
        return out
    key = np.sort(context.astype(np.uint32 if bits <= 16 else np.uint64) << 16 | x)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    kinds = key[first].astype(np.int64)
    own = kinds >> 16
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    best = np.maximum.reduceat(count << 16 | kinds & 0xFFFF, starts)
    level = 1 + np.searchsorted(_SHARES, (best >> 16) / (np.add.reduceat(count, starts) + 1.0), "right")
    out[own[starts]] = level << 16 | best & 0xFFFF
    return out


def _hoped() -> np.ndarray:
    """How often, times 100, each term of each state counts as used before anything is."""
    level = np.arange(_STATES)
    hope = np.array([0, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95])
    two, one = hope[level >> 4], hope[level >> 1 & 7]
    rest = (1 - two) * (1 - one)
    return np.rint(1600 * np.stack([two, (1 - two) * one, rest * 0.9, rest * 0.1], 1)).astype(np.int64) + 1


_HOPED = _hoped()


class _Model:
    """What the ids of the steps so far say; ``ids``: (steps, lanes), ``used``: how often each term of each state was used."""

    def __init__(self, ids: np.ndarray, used: np.ndarray):
        used = 100 * used + _HOPED
        self.one = _followers(ids[:-1].ravel(), ids[1:].ravel(), 16)
        self.two = _followers(_hash2(ids[1:-1], ids[:-2]).ravel(), ids[2:].ravel(), _BITS2)
        counts = np.bincount(ids.ravel(), minlength=65536)
        self.n = float(ids.size)
        self.count, self.first = counts.astype(float), (np.cumsum(counts) - counts).astype(float)
        self.sorted = np.repeat(np.arange(65536, dtype=np.uint16), counts)
        weight = np.maximum((int(_UNIT) - 4) * used // used.sum(1, keepdims=True), 1)  # in integers, the same on every machine
        level = np.arange(_STATES)
        weight[level >> 4 == 0, 0] = 0
        weight[level >> 1 & 7 == 0, 1] = 0
        if not ids.size:
            weight[:, 2] = 0
        weight[:, 3] += int(_UNIT) - weight.sum(1)
        weight = weight.astype(float)
        self.ends = np.cumsum(weight, 1)
        self.start, self.width = (self.ends - weight).ravel(), weight.ravel()

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order 2's id, order 1's id, mixing state) after ``b``, ``a``."""
        two, one = self.two[_hash2(a, b)], self.one[a]
        c2, c1 = two & np.uint32(0xFFFF), one & np.uint32(0xFFFF)
        return c2, c1, (two >> np.uint32(16) << np.uint32(4)) | (one >> np.uint32(16) << np.uint32(1)) | (c1 == c2)


def _segments(steps: int) -> list[tuple[int, int]]:
    at = [0, *(p for p in REFRESH if p < steps), steps]
    return list(zip(at, at[1:], strict=False))


def encode(ids: np.ndarray) -> bytes:
    """A block of at most ``BLOCK`` ids (uint16): the words of each lane as uint16, then the words, lane by lane."""
    lanes, steps = shape(len(ids))
    if not len(ids):
        return b""
    past = np.zeros((steps + 2, lanes), np.uint16)  # two ids of 0 come before a lane's own
    filled = np.zeros(lanes * steps, np.uint16)
    filled[: len(ids)] = ids
    past[2:] = filled.reshape(lanes, steps).T
    low, rng = np.zeros(lanes), np.full(lanes, _TOP)
    out, pos = np.zeros((lanes, 2 * steps + 8), np.uint32), np.zeros(lanes, np.int64)
    used = np.zeros((_STATES, 4), np.int64)
    for p, q in _segments(steps):
        model = _Model(past[2 : p + 2], used)
        for lo in range(p, q, _CHUNK):
            hi = min(q, lo + _CHUNK)
            x = past[lo + 2 : hi + 2]
            c2, c1, state = model.look(past[lo + 1 : hi + 1], past[lo:hi])
            count, first = model.count[x], model.first[x]
            term = np.where((x == c2) & (state >= 16), 0, np.where((x == c1) & (state & 14 > 0), 1, np.where(count > 0, 2, 3)))
            used += np.bincount((state * np.uint32(4) + term).ravel(), minlength=4 * _STATES).reshape(_STATES, 4)
            at = state * 4 + term
            start, width = model.start[at], model.width[at]
            n = np.where(term < 2, 1.0, np.where(term == 2, max(model.n, 1.0), 65536.0))
            first = np.where(term == 2, first, np.where(term == 3, x, 0.0))
            count = np.where(term == 2, count, 1.0)
            for j in range(hi - lo):
                r = np.floor(rng * (1 / _UNIT))
                low += start[j] * r
                r *= width[j]
                r = np.floor(r / n[j])
                low += first[j] * r
                rng = count[j] * r
                m = np.flatnonzero(rng < _BOTTOM)
                while len(m):
                    word = np.floor(low[m] * (1 / _BOTTOM))
                    out[m, pos[m]] = word
                    pos[m] += 1
                    low[m] = (low[m] - word * _BOTTOM) * 65536
                    g = rng[m] * 65536
                    rng[m] = g
                    m = m[g < _BOTTOM]
    # one more word tells the lane's last interval: its lower bits may be 0
    out[np.arange(lanes), pos] = np.ceil(low * (1 / _BOTTOM))
    pos += 1
    width = int(pos.max())
    for k in range(width - 1, 0, -1):  # carries
        out[:, k - 1] += out[:, k] >> 16
    whole = (out[:, :width] & 0xFFFF).astype("<u2")
    return pos.astype("<u2").tobytes() + whole[np.arange(width) < pos[:, None]].tobytes()


def decode(data: bytes, n: int) -> np.ndarray:
    """The ``n`` ids that ``encode`` was given; raises ValueError where the data can't be such a block's."""
    lanes, steps = shape(n)
    if not n:
        return np.zeros(0, np.uint16)
    words = np.frombuffer(data, "<u2")
    size = words[:lanes].astype(np.int64)
    if len(size) < lanes or len(words) != lanes + size.sum():
        raise ValueError("the block has another length")
    ends = np.cumsum(size)
    flat = np.append(words[lanes:], np.zeros(1, np.uint16)).astype(float)
    stop = len(flat) - 1  # a lane reads zeros after its own words
    at = ends - size

    def take(m: np.ndarray) -> np.ndarray:
        k = at[m]
        at[m] = k + 1
        return flat[np.where(k < ends[m], k, stop)]

    every = np.arange(lanes)
    code = np.zeros(lanes)
    for _ in range(3):
        code = code * 65536 + take(every)
    rng = np.full(lanes, _TOP)
    past = np.zeros((steps + 2, lanes), np.uint16)
    used = np.zeros((_STATES, 4), np.int64)
    for p, q in _segments(steps):
        model = _Model(past[2 : p + 2], used)
        e0, e1, e2 = (np.ascontiguousarray(model.ends[:, k]) for k in range(3))
        seen = []
        for j in range(p, q):
            c2, c1, state = model.look(past[j + 1], past[j])
            r = np.floor(rng * (1 / _UNIT))
            term = (code >= e0[state] * r).view(np.int8) + (code >= e1[state] * r) + (code >= e2[state] * r)
            where = state * 4 + term
            seen.append(where)
            code -= model.start[where] * r
            r *= model.width[where]
            x = np.where(term == 0, c2, c1).astype(np.uint16)
            m = np.flatnonzero(term == 2)
            if len(m):
                g = np.floor(r[m] / model.n)
                d = code[m]
                sym = model.sorted[np.minimum(np.floor(d / g), model.n - 1).astype(np.int64)]
                x[m] = sym
                code[m] = d - model.first[sym] * g
                r[m] = model.count[sym] * g
            m = np.flatnonzero(term == 3)
            if len(m):
                g = np.floor(r[m] * (1 / 65536))
                d = code[m]
                sym = np.minimum(np.floor(d / g), 65535)
                x[m] = sym
                code[m] = d - sym * g
                r[m] = g
            rng = r
            m = np.flatnonzero(rng < _BOTTOM)
            while len(m):
                code[m] = code[m] * 65536 + take(m)
                g = rng[m] * 65536
                rng[m] = g
                m = m[g < _BOTTOM]
            past[j + 2] = x
        used += np.bincount(np.concatenate(seen), minlength=4 * _STATES).reshape(_STATES, 4)
    return past[2:].T.ravel()[:n]
