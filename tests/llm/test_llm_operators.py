"""The training-data operators on Spark: brute force, SQL, and odd tables."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import chat, decontaminate, exact_dedup, langid, near_dedup, packing, quality, queries, secret_scan, token_counts, token_files, tokens
from tessera.llm.common import is_held_out

DATA = "/root/testdata/sf0.001"
VOCABULARY = tokens.vocabulary_path()
WORDS = [f"w{i}" for i in range(400)]


def long_text(seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, 400, n))


ODD_ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "oNE"), (5, "oNE"), (None, "one"), (6, "a b c d e f"), (7, "A b c d e f"), (8, "!!! 123 $$$"),
    (9, long_text(1)), (10, long_text(1) + " tail"), (11, long_text(1).upper()), (12, "é" * 30_000), (13, "x y " * 20_000), (14, "<|endoftext|> </s> \\ <| token=abcdefgh"), (None, None), (15, long_text(2)), (-3, "minus"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that the operators use inside."""
    extra = {c: F.lit(7) for c in ("part", "row", "digest", "id", "key", "shard", "component", "_id", "_sha", "_gone", "_bad", "_accepted", "score", "start", "n", "label")}
    return spark.createDataFrame(ODD_ROWS, "doc_id long, text string").withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long"), **extra}).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


#: The library as it comes, apart from the operators' own loader.
LIBRARY = Tokenizer.from_file(VOCABULARY)


def ids_of(text, end):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---------------------------------------------------------------- each operator against brute force


def check_token_files(rows, got):
    assert len(got) == len(rows)
    want = collections.Counter((d, len(i := ids_of(t, 2)), crc(i)) for d, t in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert keys == sorted(keys)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens


def test_token_files(spark, odd, docs, tmp_path):
    check_token_files(ODD_ROWS, token_files.op1(spark, odd).collect())
    check_token_files([(r.doc_id, r.text) for r in docs.collect()], token_files.op1(spark, docs).collect())
    token_files.write(odd, str(tmp_path / "f"), VOCABULARY, frame_ids=5000)
    whole = {r.doc_id: r.ids for r in token_files.read(spark, str(tmp_path / "f")).collect()}
    assert whole[14] == ids_of(ODD_ROWS[15][1], 2)


def test_secret_scan(odd, docs):
    from test_llm_kernels import spans

    for df, n in ((odd, len(ODD_ROWS)), (docs, docs.count())):
        got = secret_scan.op2(df).collect()
        assert len(got) == n
        texts = collections.Counter((r.doc_id, hashlib.sha256(spans(r.text or "").encode()).hexdigest()) for r in df.select("doc_id", "text").collect())
        assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == texts


def test_token_counts(spark, odd, docs):
    for df in (odd, docs):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = token_counts.op3(spark, df).collect()
        assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((d, len(ids_of(t, 0)) - 1) for d, t in rows)
        assert all(r.ended for r in got)


def test_flat_files_stitch_blocks(spark, tmp_path):
    rng = np.random.default_rng(0)
    sizes = [0, 1, 250, 7, 0, 0, 99, 3]
    stream = np.concatenate([np.append(rng.integers(0, 50_000, n), token_counts.END_ID) for n in sizes] + [np.array([5, 6])])
    (tmp_path / "a.bin").write_bytes(stream.astype("<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    for size in (1, 3, 64, 1000):
        got = token_counts.count(token_counts.flat_files(spark, str(tmp_path / "*.bin"), size)).orderBy("ordinal").collect()
        assert [(r.n_tokens, r.ended) for r in got] == [(n, True) for n in sizes] + [(2, False)]
        assert [r.start for r in got] == np.cumsum([0, *(n + 1 for n in sizes)]).tolist()


def test_quality(spark, docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op4(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(got.doc_id, got.held_out, strict=True))


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (5, 0), (6, None), (None, 1), (99, 1), (12, 0), (13, 1), (14, 0)], "doc_id long, quality int").withColumns({"text": F.lit("x"), "label": F.lit(3), "score": F.lit(0)})
    got = quality.op4(odd, labels).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in ODD_ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_text = collections.defaultdict(set)
    for r, score in ((dict(ODD_ROWS).get(r.doc_id), r.score) for r in got if r.doc_id not in (5, None)):
        by_text[r or ""].add(score)
    assert all(len(x) == 1 for x in by_text.values())
    assert {r.score for r in quality.op4(odd, labels.filter("false")).collect()} == {0.5}
    # the sample is the same however the rows lie, and has no more than it may
    few = [sorted(map(str, quality.sample(x, labels, 3).doc_id)) for x in (odd, odd.repartition(7).sortWithinPartitions(F.desc("doc_id")))]
    assert few[0] == few[1]
    assert len(set(few[0])) == 3


def test_quality_never_reads_held_out_labels(docs, spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.op4(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def check_packing(rows, got):
    seqs, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    want = collections.Counter()
    for d, t in rows:
        ids = ids_of(t, 0)
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want.update((d, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_packing(odd, docs):
    check_packing(ODD_ROWS, packing.op5(odd).collect())
    check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.op5(docs).collect())


def test_exact_dedup(odd, docs):
    for df in (odd, docs):
        rows = [(r.doc_id, (r.text or "").encode().lower()) for r in df.select("doc_id", "text").collect()]
        groups = collections.defaultdict(list)
        for d, t in rows:
            groups[t].append(d)
        best = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
        want = collections.Counter((d, best[t], len(groups[t]), hashlib.sha256(t).hexdigest()) for d, t in rows)
        for history in (None, F.lit(True), F.lit(False)):
            got = exact_dedup.groups(df, history).collect()
            assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
            kept = [r.text_sha256 for r in got if r.kept]
            assert len(kept) == len(set(kept)) == len(groups)
            assert all(r.doc_id == r.keep_id for r in got if r.kept)
        assert exact_dedup.deduped(df).count() == len(groups)
        assert exact_dedup.deduped(df).columns == df.columns


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in parent}


def edited(base, seed, edits):
    w, r = base.split(), np.random.default_rng(seed)
    for i in r.integers(0, len(w), edits):
        w[i] = f"e{seed}x{i}"
    return " ".join(w)


def test_near_dedup(spark, odd, docs):
    base = long_text(5, 150)
    family = [(i, edited(base, i, i % 9)) for i in range(120)] + [(1000 + i, base + f" own tail {i}") for i in range(20)] + [(2000 + i, base) for i in range(30)]
    shared = [(3000 + i, long_text(9, 60) + " " + long_text(4000 + i, 60)) for i in range(40)]
    rows = family + shared + [(r.doc_id + 10_000, r.text) for r in docs.collect()]
    got = near_dedup.op7(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    sizes = {d: len(shingles(t)) for d, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    got = near_dedup.op7(odd).collect()
    assert len(got) == len(ODD_ROWS)
    want = brute_components([(d, t) for d, t in ODD_ROWS if d is not None])
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dedup.deduped(odd).columns == odd.columns


@pytest.mark.parametrize("small", [8, 128])
@pytest.mark.parametrize("centre", [True, False])
def test_near_dedup_of_large_groups(spark, monkeypatch, small, centre):
    """Copies of one text with few and with many words edited, some edits shared, with and without the text itself."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    R, base = np.random.default_rng(11), long_text(77, 60)
    rows = [(0, base)] if centre else []
    for i in range(1, 400):
        w = base.split()
        for k in R.integers(0, 60, int(R.integers(1, 5))):
            w[k] = f"e{k}" if R.random() < 0.3 else f"e{i}x{k}"
        rows.append((i, " ".join(w[: int(R.integers(50, 61))])))
    got = near_dedup.op7(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_near_dedup_compares_few_pairs_of_a_large_group(spark, monkeypatch):
    """Twice the copies must not make four times the pairs, where each copy has another word changed."""
    counts = {}
    for n in (300, 600):
        base, rows = long_text(78, 40), []
        for i in range(n):
            w = base.split()
            w[i % 40] = f"e{i}"
            rows.append((i, " ".join(w)))
        real, seen = near_dedup.saved, []

        def counted(df, path, real=real, seen=seen):
            out = real(df, path)
            seen.append(out.count() if path.endswith("_pairs") else 0)
            return out

        monkeypatch.setattr(near_dedup, "saved", counted)
        got = near_dedup.op7(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        monkeypatch.undo()
        assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
        counts[n] = sum(seen)
    assert counts[600] < 3 * counts[300]


def test_near_dedup_lists_pairs_of_small_buckets(spark, monkeypatch):
    """Families of a few documents that share buckets but hardly a link: nothing is joined by shingles."""
    rows = []
    for f in range(40):
        base = long_text(500 + f, 120)
        rows += [(10 * f + i, edited(base, 10 * f + i, (0, 1, 7, 7, 8)[i])) for i in range(5)]
    for listed in (2, 16):
        real, seen = near_dedup.saved, {}

        def counted(df, path, real=real, seen=seen):
            out = real(df, path)
            seen[path.rsplit("/", 1)[-1]] = out.count()
            return out

        monkeypatch.setattr(near_dedup, "saved", counted)
        monkeypatch.setattr(near_dedup, "LISTED", listed)
        got = near_dedup.op7(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        monkeypatch.undo()
        assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
        assert seen["mixed"] > 0
        assert (seen.get("shingles", 0) == 0) == (listed == 16)
        assert listed == 2 or seen["found"] > 0


def test_near_dedup_of_repeated_ids(spark):
    """An id on rows with different texts is one node: it links with what either text links with."""
    a, b = long_text(91, 80), long_text(92, 80)
    rows = [(3, a), (5, a), (5, b), (9, edited(b, 1, 1)), (11, long_text(93, 80))] + [(20, long_text(94, 80))] * 3
    got = {r.doc_id: r.component_id for r in near_dedup.op7(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 11: 11, 20: 20}


def test_pairs_with_frequent_ends_on_both_sides(spark, monkeypatch):
    """Ids that stand in very many pairs are dealt out on either side; every pair is compared once."""
    monkeypatch.setattr("tessera.llm.common.HOT_ROWS", 20)
    monkeypatch.setattr("tessera.llm.common.HOT_SHARE", 20)
    sets = {i: list(range(i % 3, i % 3 + 20)) for i in range(200)}
    pairs = [(i, 0) for i in range(1, 200)] + [(0, i) for i in range(1, 30)] + [(0, 0)]
    df = spark.createDataFrame(list(sets.items()), "id long, s array<long>")
    got = near_dedup.verify(spark.createDataFrame(pairs, "a long, b long"), df, near_dedup.scratch_dir(spark)).collect()
    alike = lambda x, y: 4 * len({*sets[x]} & {*sets[y]}) >= 3 * len({*sets[x]} | {*sets[y]})
    assert sorted((r.a, r.b) for r in got) == sorted(p for p in pairs if alike(*p))


def test_chat(spark):
    rows = [(1, 0, "system", "be <|start|> kind"), (1, 1, "user", "hi \\ <\\| <|"), (1, 2, "assistant", "yes\n<|end|>"), (1, 3, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (3, 1, "assistant", ""), (3, None, "assistant", "first"), (None, 5, "user", "u"), (4, 0, "assistant", "a"), (4, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in chat.op8(spark, df).collect()}
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    names = [d[0] for d in con.execute(chat.ORACLE).description]
    for row in con.execute(chat.ORACLE).fetchall():
        w = dict(zip(names, row, strict=True))
        r = got.pop(w["conv_id"])
        assert {k: r[k] for k in names} == w
    assert not got
    ex = [r for r in chat.examples(df).collect() if r.conv_id == 1]
    assert len(ex) == 2
    assert [r.formatted[r.loss_start : r.loss_end] for r in sorted(ex, key=lambda r: r.example)] == ["yes\n<\\|end|>", ""]


def test_decontamination(spark, odd, docs):
    R = np.random.default_rng(3)
    items = [(i, long_text(700 + i, int(R.integers(8, 60)))) for i in range(12)] + [(50, "two words"), (51, ""), (52, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = [(i, long_text(100 + i, 200)) for i in range(60)]
    dirty = []
    for i in range(40):
        item = items[i % 12][1].split()
        for k in R.integers(0, len(item), len(item) // 8):
            item[k] = f"edit{i}{k}"
        dirty.append((1000 + i, long_text(5000 + i, 100) + " " + ", ".join(item).title() + " " + long_text(6000 + i, 50)))
    df = spark.createDataFrame(clean + dirty + [(None, "two words"), (7777, None), (7778, "")], "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.op9(df, bench).collect()}
    assert {d for d, _ in got} == {d for d, _ in dirty} | {None}
    assert all((1000 + i, i % 12) in got for i in range(40))
    from test_llm_kernels import plain_alignment

    texts, by_id = dict(dirty), dict(items)
    for (d, item), score in got.items():
        if d is not None:
            norm = lambda t: t.lower().replace(",", " ").split()
            assert abs(score - plain_alignment(norm(by_id[item]), norm(texts[d])) / (2 * len(by_id[item].split()))) < 1e-9
    assert decontaminate.cleaned(df, bench).count() == len(clean) + 2
    verbatim = duckdb.sql(f"select distinct doc_id from '{DATA}/documents.parquet' d join '{DATA}/benchmark.parquet' b on contains(d.text, b.text)").fetchall()
    flagged = {r.doc_id for r in decontaminate.op9(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert {d for (d,) in verbatim} <= flagged
    assert decontaminate.cleaned(odd, bench.filter("false")).count() == len(ODD_ROWS)
    assert decontaminate.cleaned(odd, bench).columns == odd.columns


def test_decontamination_of_odd_rows(odd, spark):
    items = [(1, "a b c d e f"), (2, "one"), (3, long_text(1)), (4, "x y " * 40), (5, None), (6, ""), (7, "minus"), (7, "minus"), (None, "é" * 30_000)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "score", "id", "key", "_bad", "n")})
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.op9(odd, bench).collect())
    want = collections.Counter({(4, 2): 1, (5, 2): 1, (None, 2): 1, (6, 1): 1, (7, 1): 1, (9, 3): 1, (10, 3): 1, (11, 3): 1, (13, 4): 1, (-3, 7): 1, (12, None): 1})
    assert got == want
    left = collections.Counter((r.doc_id, r.text) for r in decontaminate.cleaned(odd, bench).collect())
    assert left == collections.Counter((d, t) for d, t in ODD_ROWS if d in (1, 2, 3, 8, 14, 15) or (d is None and t is None))


@pytest.mark.parametrize("copies", [11, 1000])
@pytest.mark.parametrize("verbatim", [0, 3, 40])
def test_decontamination_of_one_edited_copy_in_many_documents(spark, copies, verbatim):
    bench = spark.createDataFrame([(1, long_text(900, 40)), (2, long_text(901, 40))], "item_id long, text string")
    item = long_text(900, 40).split()
    for every in (4, 5):
        copy = " ".join(f"x{k}" if k % every == every - 1 else w for k, w in enumerate(item))
        rows = [(i, f"{long_text(20_000 + i, 30)} {copy} {long_text(40_000 + i, 30)}") for i in range(copies)]
        rows += [(5000 + i, f"{long_text(60_000 + i, 30)} {' '.join(item)}") for i in range(verbatim)]
        clean = [(9000 + i, long_text(70_000 + i, 100)) for i in range(20)]
        df = spark.createDataFrame(rows + clean, "doc_id long, text string").repartition(4)
        assert {(r.doc_id, r.item_id) for r in decontaminate.op9(df, bench).collect()} == {(d, 1) for d, _ in rows}
        assert {r.doc_id for r in decontaminate.cleaned(df, bench).collect()} == {d for d, _ in clean}


def test_decontamination_keeps_clean_rows_of_null_and_repeated_ids(spark):
    bench = spark.createDataFrame([(1, long_text(900, 40))], "item_id long, text string")
    bad = f"Ñ é {long_text(900, 40)} tail"
    rows = [(None, bad), (None, long_text(1)), (None, None), (7, bad), (7, long_text(2)), (7, long_text(2)), (7, ""), (8, bad), (9, long_text(3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = collections.Counter((d, t) for d, t in rows if t != bad)
    assert collections.Counter(map(tuple, decontaminate.cleaned(df, bench).collect())) == want


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op10(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()
    spoiled = docs.withColumn("lang", F.when(is_held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(tuple, langid.op10(spoiled).collect())) == sorted(map(tuple, langid.op10(docs).collect()))
    rows = {(r.doc_id, r.lang_pred) for r in langid.op10(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und")} <= rows
    assert (4, "en") in rows
    assert langid.accepted(odd).columns == odd.columns
    # 13: thousands of words of which training has seen no trigram
    known = collections.Counter((d, t) for d, t in ODD_ROWS if t and any(c.isalpha() for c in t) and d != 13)
    assert collections.Counter((r.doc_id, r.text) for r in langid.accepted(odd).collect()) == known
    twice = spark.createDataFrame([(7, "123", "en"), (7, "a text", "en"), (8, "a text", "en")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.text) for r in langid.accepted(twice).collect()) == [(7, "a text"), (8, "a text")]


def test_documents_in_three_languages_are_accepted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    words = {lang: [w for r in docs.filter(F.col("lang") == lang).orderBy("doc_id").limit(20).collect() for w in r.text.split()] for lang in ("de", "en", "es", "fr")}
    mixed = " ".join(words["de"][:80] + words["es"][:70] + words["fr"][:50])
    df = docs.union(spark.createDataFrame([(-1, mixed, None), (-2, "123 !", None)], docs.schema))
    r = langid.op10(df).filter("doc_id = -1").first()
    assert r.mixture.count("=") == 3
    assert r.score < 0.5
    assert [x.doc_id for x in langid.accepted(df).filter("doc_id < 0").collect()] == [-1]


def test_language_stage_decides_by_inference(spark):
    """Text that no learned language explains goes though it has letters; plain sums of trigram likelihoods say the same."""
    import math
    import random

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(6)
    junk = lambda n, k: " ".join("".join(r.choice("qxzjkwvy") for _ in range(k)) for _ in range(n))
    other = "пример текста на языке которого нет среди изученных и который поэтому никому не знаком совсем "
    real = docs.filter("lang = 'fr'").orderBy("doc_id").first().text
    added = [(-1, junk(200, 7), None), (-2, other * 12, None), (-3, "xqz", None), (-4, real, None), (-5, real[:400] + " " + junk(3, 6), None), (-6, None, None), (-7, "1234 !", None)]
    df = docs.union(spark.createDataFrame(added, docs.schema))
    kept = {x.doc_id for x in langid.accepted(df).collect()}
    assert kept & {x[0] for x in added} == {-3, -4, -5}
    # every document of the table that has a letter is prose of a learned language
    assert {x.doc_id for x in docs.collect() if any(c.isalpha() for c in x.text or "")} == kept - {-3, -4, -5}
    model = langid.fit(df)
    for doc, text, _ in added[:2] + added[3:4]:
        data = np.frombuffer(text.encode(), np.uint8)
        bucket, offs, word, _ = langid._words(data, np.array([0, len(data)]))
        by_word = np.add.reduceat(model.logp[bucket], offs[:-1], axis=0).astype(float) * langid.TEMPER
        none = langid.TEMPER * langid.BACKGROUND * np.diff(offs)
        # each word by its best language: no mixture does better
        assert (none[word].sum() - by_word.max(1)[word].sum() > langid.PENALTY * math.log(len(word) + 1)) == (doc in (-1, -2))


# ---------------------------------------------------------------- empty tables, the pipeline, the registry


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert token_files.op1(spark, empty).count() == 0
    assert secret_scan.op2(empty).count() == 0
    assert token_counts.op3(spark, empty).count() == 0
    assert quality.op4(empty, labels).count() == 0
    assert packing.op5(empty).count() == 0
    assert exact_dedup.op6(empty).count() == 0
    assert near_dedup.op7(empty).count() == 0
    assert chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert decontaminate.op9(empty, bench).count() == 0
    assert langid.op10(empty).count() == 0


def test_chat_of_long_texts_and_no_rows(spark):
    long = "<|start|>\\ é" * 40_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.op8(spark, df).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{long}\nassistant\n{long}\n\n\n".encode()).hexdigest()
    assert [r.conv_id for r in chat.op8(spark, df.filter("false")).collect()] == [-1]


def test_pipeline_of_no_rows(spark, empty, tmp_path):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, DATA)
        assert out.count() == 0
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    # a first stage that keeps nothing
    none = spark.createDataFrame([(1, "1 2 3", "en", "s", 5), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, odd):
    labels = [n for n, _ in corpus_pipeline.STAGES]
    assert labels == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == odd.columns
    # 1, 2, 3, 8 and the null text have no letters, 13 is in no learned language; 4, 5, 5 and null hold one text, 6 and 7 one, 9 to 11 near copies
    assert {r.doc_id for r in docs.collect()} == {5, 7, 10, 12, 14, 15, -3}


def test_pipeline_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    by_id = dict(docs)
    lang = {r.doc_id for r in langid.op10(spark.read.parquet(f"{DATA}/documents.parquet")).filter("lang_pred <> 'und' and score >= 0.5").collect()}
    left = [(d, t) for d, t in docs if d in lang]
    best = {}
    for d, t in left:
        k = (t or "").encode().lower()
        best[k] = max(best.get(k, d), d)
    left = [(d, by_id[d]) for d in sorted(best.values())]
    comp = brute_components(left)
    left = [(d, t) for d, t in left if comp[d] == d]
    bad = {r.doc_id for r in decontaminate.op9(spark.createDataFrame(left, "doc_id long, text string"), spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    check_packing([(d, t) for d, t in left if d not in bad], corpus_pipeline.run(spark, DATA).collect())


def test_registry(spark):
    import __spark_entry__ as entry_module

    names = set(entry_module.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}
    assert set(queries.QUERIES) <= names
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.execute(sql)
        cols = [d[0] for d in want.description]
        got = queries.QUERIES[name](spark, DATA)
        assert sorted(got.columns) == sorted(cols)
        assert collections.Counter(map(tuple, got.select(*cols).collect())) == collections.Counter(want.fetchall())
