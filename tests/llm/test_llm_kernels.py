"""The training-data operators' kernels against plain restatements; no Spark."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import decontaminate, exact_dedup, langid, near_dedup, packing, quality, range_coder, secret_scan, token_files, tokens
from tessera.llm.common import Words, gram_hashes, lower_ascii, text_blocks

VOCABULARY = tokens.vocabulary_path()
#: The library as it comes, apart from the operators' own loader.
LIBRARY = Tokenizer.from_file(VOCABULARY)


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)


odd_text = st.lists(st.sampled_from([*"ab Z\n'stlé1.\t ñ　<|x>\x85\r😀—,;×", "<|endoftext|>"]), max_size=40).map("".join)


# ---------------------------------------------------------------- tokens


@given(st.lists(odd_text, max_size=8))
@settings(max_examples=200, deadline=None)
def test_block_encoding_is_the_librarys(texts):
    ids, off = tokens.encode_block(*block(texts), VOCABULARY)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_append_end():
    ids, off = tokens.append_end(np.array([5, 6, 7], np.uint32), np.array([0, 2, 2, 3]), 9)
    assert ids.tolist() == [5, 6, 9, 9, 7, 9]
    assert off.tolist() == [0, 3, 4, 6]


# ---------------------------------------------------------------- range coder


@given(st.lists(st.integers(0, 65535) | st.integers(0, 3), max_size=400), st.integers(1, 90))
@settings(max_examples=60, deadline=None)
def test_coder_round_trip(ids, size):
    head, payload = token_files.pack_ids(np.array(ids, np.uint32), size)
    assert token_files.unpack_ids(head, payload).tolist() == ids


def entropy(ids):
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(p * np.log2(p)).sum())


def test_coder_compresses_what_repeats():
    ids = np.tile(np.arange(50), 400)
    head, payload = token_files.pack_ids(ids)
    assert len(payload) < len(ids) // 6
    noise = np.random.default_rng(0).integers(0, 65536, 20_000)
    assert len(token_files.pack_ids(noise)[1]) < 2.06 * len(noise)


def test_coder_is_below_the_entropy_of_single_ids():
    """Orders 1 and 2 must pay for what a block's fresh start costs, on the documents' own ids."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids, _ = tokens.encode_block(*block([t or "" for t in texts]), VOCABULARY)
    head, payload = token_files.pack_ids(ids)
    assert 8 * (len(head) + len(payload)) / len(ids) < entropy(ids) - 0.2
    assert (token_files.unpack_ids(head, payload) == ids).all()


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 511, 513, 2000, 70_001])
def test_coder_of_every_shape(n):
    R = np.random.default_rng(n)
    for ids in (R.integers(0, 65536, n), np.full(n, 65535), R.integers(0, 3, n), R.zipf(1.3, n) % 65536):
        data = range_coder.encode(ids.astype(np.uint16))
        assert (range_coder.decode(data, n) == ids).all()
        assert range_coder.encode(ids.astype(np.uint16)) == data


def test_coder_order_contexts():
    """A text that only pairs of preceding ids foretell costs little once they have been seen."""
    R = np.random.default_rng(3)
    table, ids = R.integers(0, 1000, (50, 50)), [1, 2]
    for _ in range(100_000):
        ids.append(int(table[ids[-1] % 50, ids[-2] % 50]) if R.random() < 0.97 else int(R.integers(0, 1000)))
    assert 8 * len(range_coder.encode(np.array(ids, np.uint16))) / len(ids) < 0.35 * entropy(np.array(ids))


def test_blocks_stand_alone_and_damage_is_found():
    ids = np.random.default_rng(1).integers(0, 500, 10_000).astype(np.uint32)
    head, payload = token_files.pack_ids(ids, 4000)
    table = np.frombuffer(head, "<u4").reshape(-1, 3)
    assert table[:, 0].tolist() == [4000, 4000, 2000]
    at = int(table[0, 1])
    one = token_files.unpack_ids(table[1:2].tobytes(), payload[at : at + int(table[1, 1])])
    assert one.tolist() == ids[4000:8000].tolist()
    for place in (0, 100, len(payload) // 2):
        bad = bytearray(payload)
        bad[place] ^= 255
        with pytest.raises(token_files.DamagedFile):
            token_files.unpack_ids(head, bytes(bad))
    with pytest.raises(token_files.DamagedFile):
        token_files.unpack_ids(head, payload[:-1])
    with pytest.raises(ValueError, match="65536"):
        token_files.pack_ids(np.array([70_000]))


# ---------------------------------------------------------------- secrets


def spans(text):
    """Plain restatement of the base kinds on code points."""
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


piece = st.sampled_from(["password", "PassWd", "token=", "api_key : ", "apikey", "secret\"='", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "abc", " ", "é", "=", "a/b+c_d", "\n", "tſoken=abcdefgh", "Kelvin Key"])


@given(st.lists(st.lists(piece, max_size=12).map("".join), max_size=5))
@settings(max_examples=200, deadline=None)
def test_base_spans(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    rows = pa.Table.from_batches(list(secret_scan._scan(secret_scan.BASE_RULES, 3)([batch])) or [], None if texts else pa.schema([])).to_pylist() if texts else []
    for text, r in zip(texts, rows, strict=True):
        assert r["spans"] == spans(text)
        assert r["base_sha256"] == hashlib.sha256(spans(text).encode()).hexdigest()


def test_long_runs_are_read_once():
    took = []
    for n in (20_000, 200_000):
        start = time.perf_counter()
        assert not any(r.compiled().search(b"eyJ" * n) for r in secret_scan.MORE_RULES)
        took.append(time.perf_counter() - start)
    assert took[1] < 40 * took[0] + 0.5
    jwt = next(r for r in secret_scan.MORE_RULES if r.kind == "jwt")
    token = b"eyJ" + b"a" * 20 + b".eyJ" + b"b" * 20 + b"." + b"c" * 20
    assert [m.group(1) for m in jwt.compiled().finditer(b"t=" + token + b" x" + token + b" a_eyJ-" + token + b" eyJ." + token)] == [token, token, b"eyJ-" + token, token]
    # as the plain pattern finds them, that reads a run again from each of its beginnings
    plain = re.compile(rb"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
    rng = random.Random(3)
    for _ in range(3000):
        text = b"".join(rng.choice([b"eyJ", b"eyJ", b".", b" ", b"a" * 7, b"b" * 10, b".eyJ" + b"c" * 10, token[:24]]) for _ in range(rng.randrange(14)))
        assert [m.span(1) for m in jwt.compiled().finditer(text)] == [m.span() for m in plain.finditer(text)], text


def test_more_rules_add_spans_only():
    text = "ghp_" + "a1B2" * 9 + " and password=abcdef1 -----BEGIN RSA PRIVATE KEY-----"
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    (r,) = pa.Table.from_batches(list(secret_scan._scan((*secret_scan.BASE_RULES, *secret_scan.MORE_RULES), 3)([batch]))).to_pylist()
    assert r["base_sha256"] == hashlib.sha256(spans(text).encode()).hexdigest()
    assert [s.split(":")[0] for s in r["spans"].split(",")] == ["github", "assign", "private_key"]


@pytest.mark.parametrize(("pattern", "texts"), [("abc(def|xyz)+", ["abcdef", "abcxyzdef"]), ("ab[cd]e", ["abce", "abde"]), ("x*", ["", "xxx"]), ("(?i:Token)s?", ["TOKEN", "tokens"]), ("foo.*bar", ["foo bar"])])
def test_trigram_queries_hold_for_matches(pattern, texts):
    query = secret_scan.trigram_query(pattern)
    index = secret_scan.TrigramIndex(*block(texts), sorted(secret_scan.trigrams_of(query)))
    got = index.candidates(query)
    assert got is None or got.tolist() == list(range(len(texts)))


# ---------------------------------------------------------------- quality


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.train(x[:1500], y[:1500])
    p = trees.score(x[1500:])
    assert ((p >= 0.5) == y[1500:]).mean() > 0.95
    walked = np.full(5, trees.base)
    for t in range(len(trees.leaf)):  # node by node
        for i in range(5):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + 1 + int(x[1500 + i, trees.feature[t, node]] > trees.threshold[t, node])
            walked[i] += trees.leaf[t, node - trees.feature.shape[1]]
    assert np.allclose(1 / (1 + np.exp(-walked)), p[:5])


def test_training_is_plain_boosting():
    """Every split and leaf against loops over rows, nodes, features and bins."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(80, 3)), 1)
    y = (x[:, 0] + 0.3 * rng.normal(size=80) > 0.2).astype(float)
    bins, depth, rate = 8, 2, 0.3
    got = quality.train(x, y, trees=3, depth=depth, rate=rate, bins=bins)
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1]).tolist())) for f in range(3)]
    total = [float(np.log(y.mean() / (1 - y.mean())))] * 80
    assert got.base == total[0]
    for t in range(3):
        p = [1 / (1 + np.exp(-v)) for v in total]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        side = lambda rows: (sum(g[r] for r in rows), sum(h[r] for r in rows))  # noqa: E731, B023
        worth = lambda s: s[0] ** 2 / (s[1] + quality.L2)
        nodes = {0: list(range(80))}
        for node in range(2**depth - 1):
            rows, best = nodes[node], (1e-9, 0, np.inf)
            for f in range(3):
                for e in edges[f]:
                    left, right = side([r for r in rows if x[r, f] <= e]), side([r for r in rows if x[r, f] > e])
                    gain = worth(left) + worth(right) - worth(side(rows))
                    if min(left[1], right[1]) >= 1e-3 and gain > best[0] + 1e-12:
                        best = (gain, f, e)
            assert (got.feature[t, node], got.threshold[t, node]) == best[1:]
            nodes[2 * node + 1] = [r for r in rows if x[r, best[1]] <= best[2]]
            nodes[2 * node + 2] = [r for r in rows if x[r, best[1]] > best[2]]
        for leaf in range(2**depth):
            rows = nodes[2**depth - 1 + leaf]
            a, b = side(rows)
            assert np.isclose(got.leaf[t, leaf], -rate * a / (b + quality.L2))
            for r in rows:
                total[r] -= rate * a / (b + quality.L2)


def test_trees_of_one_class_or_none():
    x = np.zeros((3, len(quality.FEATURES)))
    assert np.allclose(quality.train(x, np.ones(3)).score(x), 1, atol=1e-5)
    assert np.allclose(quality.train(x[:0], np.zeros(0)).score(x), 0.5)


def test_statistics_of_odd_texts():
    x = quality.statistics(*block(["", " \n", "a", "ok then", "é" * 1000, "a b\n" * 500]))
    assert x.shape == (6, len(quality.FEATURES))
    assert np.isfinite(x).all()
    assert (x[0] == 0).all()
    assert x[5, quality.FEATURES.index("line_repeats")] > 0.99


# ---------------------------------------------------------------- packing


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=80, deadline=None)
def test_plan_places_every_piece_once(counts):
    runs = packing.plan(counts, 64, 12)
    where = collections.defaultdict(list)
    for r in runs:
        assert sum(n for n, _ in r.slots) + r.room == 64
        assert r.room >= 0
        for n, rank in r.slots:
            where[n] += range(rank, rank + r.count)
    assert {n: sorted(x) for n, x in where.items()} == {n: list(range(c)) for n, c in counts.items()}
    table = packing.places(runs)
    used = {}
    for n, c in counts.items():
        for rank in range(c):
            at = np.searchsorted(table["key"], (n << 44) + rank, "right") - 1
            used.setdefault(int(rank + table["shift"][at]), []).append((int(table["offset"][at]), n))
    for bins in used.values():
        at = 0
        for offset, n in sorted(bins):
            assert offset == at
            at += n
        assert at <= 64


def test_plan_is_near_the_bound():
    sizes = np.clip(np.random.default_rng(0).lognormal(6.5, 0.9, 20_000).astype(int), 1, 2048)
    n, c = np.unique(sizes, return_counts=True)
    runs = packing.plan(dict(zip(n.tolist(), c.tolist(), strict=True)))
    assert sum(r.count for r in runs) <= 1.01 * sizes.sum() / 2048


# ---------------------------------------------------------------- exact dedup


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
    function, slot = exact_dedup.PerfectHash.build(keys)
    assert sorted(slot.tolist()) == list(range(n))
    again = exact_dedup.PerfectHash.from_bytes(function.to_bytes())
    assert again.slots(keys).tolist() == slot.tolist()
    other = again.slots(rng.integers(0, 1 << 63, (50, 2)).astype(np.uint64))
    assert ((other >= -1) & (other < max(n, 1))).all()


def test_perfect_hash_needs_distinct_keys():
    with pytest.raises(ValueError, match="distinct"):
        exact_dedup.PerfectHash.build(np.zeros((2, 2), np.uint64))


# ---------------------------------------------------------------- near dedup


@given(st.lists(odd_text, max_size=6))
@settings(max_examples=100, deadline=None)
def test_words_and_shingles(texts):
    data, docs = block(texts)
    w = Words(lower_ascii(data), docs)
    for i, t in enumerate(texts):
        words = t.encode().lower().split()
        assert w.offsets[i + 1] - w.offsets[i] == len(words)
        assert [bytes(lower_ascii(data)[s:e]) for s, e in zip(w.starts[w.offsets[i] : w.offsets[i + 1]], w.ends[w.offsets[i] : w.offsets[i + 1]], strict=True)] == words
    sets, off = near_dedup.shingle_sets(data, docs)
    for i, t in enumerate(texts):
        words = t.encode().lower().split()
        assert off[i + 1] - off[i] == len({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else ())


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for n, shared in ((1, 1), (20, 15), (400, 300), (3000, 1500)):
        common = rng.integers(0, 1 << 63, shared).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n - shared).astype(np.uint64)])) for _ in range(2))
        s = near_dedup.sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
        assert (s != ~np.uint64(0)).all()
        want = shared / (2 * n - shared)
        assert abs((s[0] == s[1]).mean() - want) < 0.12
    assert (near_dedup.sketch(np.zeros(0, np.uint64), np.array([0, 0])) == ~np.uint64(0)).all()


# ---------------------------------------------------------------- decontamination


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_scores():
    R = random.Random(0)
    items = [np.array([R.randint(2, 6) for _ in range(R.randint(1, 12))], np.uint64) for _ in range(60)]
    windows = [np.array([R.randint(2, 6) for _ in range(R.randint(0, 20))], np.uint64) for _ in range(60)]
    got = decontaminate.smith_waterman(items, windows)
    assert got.tolist() == [plain_alignment(a, b) for a, b in zip(items, windows, strict=True)]


# ---------------------------------------------------------------- language


def test_mixture_picks_the_languages():
    R = random.Random(1)
    vocab = {"aa": ["tho", "wher", "ing"], "bb": ["schu", "ung", "keit"], "cc": ["eau", "que", "oir"]}
    text = lambda lang, n: " ".join(R.choice(vocab[lang]) for _ in range(n))
    counts = np.zeros((langid.BUCKETS, 3))
    for i, lang in enumerate(vocab):
        bucket, offs, word, _ = langid._words(*block([text(lang, 500)]))
        counts[:, i] = np.bincount(bucket, np.repeat(np.bincount(word, minlength=len(offs) - 1), np.diff(offs)), langid.BUCKETS)
    model = langid.Model(list(vocab), np.log((counts + 0.5) / (counts.sum(0) + 0.5 * 40)).astype(np.float32))
    best, share, mix = langid.infer(model, *block([text("bb", 30), text("aa", 60) + " " + text("cc", 30), "", "123 !", "…", "tho"]))
    assert best.tolist() == [1, 0, -1, -1, -1, 0]
    assert np.allclose(mix[1], [2 / 3, 0, 1 / 3], atol=0.08)
    assert share[0] == 1
    assert (share[2:5] == 0).all()


# ---------------------------------------------------------------- shared


def plain_em(words, allowed):
    """(proportions, log likelihood) of one document's words: lists of likelihoods by language."""
    pi = [1 / len(allowed) if i in allowed else 0.0 for i in range(len(words[0]))]
    for _ in range(langid.ROUNDS):
        new = [0.0] * len(pi)
        for w in words:
            z = sum(a * b for a, b in zip(pi, w, strict=True))
            new = [n + a * b / z for n, a, b in zip(new, pi, w, strict=True)]
        pi = [n / len(words) for n in new]
    return pi, sum(np.log(sum(a * b for a, b in zip(pi, w, strict=True))) for w in words)


def test_mixture_is_plain_em():
    """Shares and sets against a plain restatement, document by document."""
    rng, R = np.random.default_rng(6), random.Random(6)
    model = langid.Model(["a", "b", "c", "d"], np.log(rng.dirichlet(np.full(4, 0.2), langid.BUCKETS) + 1e-3).astype(np.float32))
    kinds = ["".join(R.choice("abcdé") for _ in range(R.randint(1, 5))) for _ in range(30)]
    texts = [" ".join(R.choice(kinds[k : k + R.choice([3, 12])]) for _ in range(R.randint(1, 60))) for k in range(25)]
    best, share, mix = langid.infer(model, *block(texts))
    for t, text in enumerate(texts):
        words = []
        for w in text.split():
            raw = b" " + w.lower().encode() + b" "
            grams = [(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761) & 0xFFFFFFFF) >> 16 for i in range(len(raw) - 2)]
            like = model.logp[grams].astype(float).sum(0) * langid.TEMPER
            words.append(np.exp(np.maximum(like - like.max(), -40)))
        alone = [sum(np.log(w[i]) for w in words) for i in range(4)]
        chosen = {int(np.argmax(alone))}
        pi, like = [float(i in chosen) for i in range(4)], alone[min(chosen)]
        cost = langid.PENALTY * np.log(len(words) + 1)
        while len(chosen) < 4:
            tries = {i: plain_em(words, chosen | {i}) for i in range(4) if i not in chosen}
            i = max(tries, key=lambda k: tries[k][1])  # noqa: B023
            if tries[i][1] - like <= cost:
                break
            chosen, (pi, like) = chosen | {i}, tries[i]
        assert np.allclose(mix[t], pi, atol=1e-3)
        assert np.isclose(share[t], max(pi), atol=1e-3)
        assert pi[best[t]] > max(pi) - 1e-3


def test_text_blocks_cover_everything():
    texts = ["a" * 50, None, "", "b" * 500, "c", "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(0)
    got = []
    for lo, hi, data, docs in text_blocks(batch, limit=60):
        assert docs[-1] <= 60 or hi == lo + 1
        got += [bytes(data[a:b]).decode() for a, b in zip(docs[:-1], docs[1:], strict=True)]
    assert got == [t or "" for t in texts]
    assert list(text_blocks(batch.slice(0, 0))) == []


def test_gram_hashes_of_short_documents():
    data, docs = block(["a b", "a b", "a b c d e f", ""])
    g, off, first = gram_hashes(Words(data, docs), 5)
    assert off.tolist() == [0, 1, 2, 4, 4]
    assert g[0] == g[1]
    assert zlib.crc32(b"") == 0


def test_decontamination_words_fold_case():
    a, b, c = (decontaminate.words_of(*block([t])).hashes.tolist() for t in ("ÑOS UEÍOS, ×", "ños ueíos ×", "nos ueios ×"))
    assert a == b != c
    assert len(decontaminate.words_of(*block([""])).hashes) == 0


def aligned(items, texts):
    """Best score of each (document, item) that decontamination finds."""
    found = decontaminate.Items(items)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = {}
    for b in decontaminate._aligned(found, list(range(len(items))), 0.5)([batch]):
        for r in b.to_pylist():
            got[r["doc_id"], r["item_id"]] = max(r["score"], got.get((r["doc_id"], r["item_id"]), 0))
    return got


@pytest.mark.parametrize("hits", [4_000_000, 5])
def test_decontamination_is_plain_alignment(monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "BLOCK_HITS", hits)
    R = random.Random(5)
    for _ in range(60):
        words = [f"v{i}" for i in range(R.choice([2, 3, 6, 30]))]
        some = lambda a, b, w=words: [R.choice([*w, "q"]) for _ in range(R.randint(a, b))]
        items = [" ".join(R.choice(words) for _ in range(R.randint(3, 14))) for _ in range(5)]
        texts = []
        for _ in range(8):
            copy = " ".join(R.choice([x, x, x, f"{x} z", "y", ""]) for x in R.choice(items).split())
            texts.append(" ".join([*some(0, 30), copy, *some(0, 30)]))
        want = {(d, i): s for d, t in enumerate(texts) for i, x in enumerate(items) if (s := plain_alignment(x.split(), t.split()) / (2 * len(x.split()))) >= 0.5}
        assert aligned(items, texts) == want


@pytest.mark.parametrize("length", [7, 8, 9, 10, 12, 16, 24, 40, 60])
def test_decontamination_loses_no_edited_copy(length):
    """Items with 1/8 to 1/3 of their words edited, among common phrases, against plain alignment over all pairs."""
    R = random.Random(length)
    items = [[R.choice(["the", "of", "and", f"w{R.randint(0, 300)}", f"w{R.randint(0, 300)}"]) for _ in range(length)] for _ in range(12)]
    texts = []
    for k, item in enumerate(items * 3):
        copy, edits = list(item), max(1, length // (8, 4, 3)[k // 12])
        for i in R.sample(range(length), edits):
            copy[i] = R.choice([f"x{i}", "", f"{copy[i]} y"])
        around = [R.choice(["the", "of", "and", f"u{R.randint(0, 300)}"]) for _ in range(40)]
        texts.append(" ".join([*around[:20], *copy, *around[20:]]))
    want = {(d, i): s for d, t in enumerate(texts) for i, x in enumerate(items) if (s := plain_alignment(x, t.split()) / (2 * length)) >= 0.5}
    assert len(want) >= 0.6 * len(texts)
    assert aligned([" ".join(x) for x in items], texts) == want


def test_seeds_are_the_rare_pairs():
    items = decontaminate.Items(["a b c d e f g h i j k l", "one two"])
    often = np.zeros(len(items.keys), np.int64)
    often[:5] = 100
    seed = items.seeds(often)
    assert seed[items.item == 1].all()
    assert 0 < seed.sum() < len(seed)
    rare = np.repeat(often, items.hi - items.lo)
    assert rare[~seed].min() >= rare[seed & (items.item == 0)].min()


def test_decontamination_of_heavy_edits():
    item = [f"w{i}" for i in range(35)]
    third = [f"x{k}" if k % 3 == 2 else w for k, w in enumerate(item)]
    spread = " y ".join(item[:8])
    got = aligned([" ".join(item), " ".join(item[:8])], ["a b " + " ".join(third) + " c", " ".join(third[:8]), f"a {spread} b"])
    assert {(0, 0), (1, 1), (2, 1)} <= set(got)
    assert got[0, 0] == plain_alignment(item, third) / 70
    assert got[1, 1] == plain_alignment(item[:8], third[:8]) / 16
