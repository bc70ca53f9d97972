"""Block join, approximate search, anchors by n-grams, longest prefixes, pacing and the breaker as a stream: small inputs against plain restatements."""

import datetime
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import anchors, ann, latent, pacing, pages, prefixes, search, tiles
from tessera.session import shared_dir
from tessera.streaming import breaker

VEC = "vec_id long, embedding array<float>"


def plain_knn(rows, queries, k, but_itself=False):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1)
    own = [(i, unit(v)) for i, v in rows if i is not None and v is not None]
    out = []
    for q, v in queries:
        if q is None or v is None:
            continue
        s = sorted((-round(float(unit(v) @ x), 9), i) for i, x in own if len(x) == len(v) and not (but_itself and i == q))
        out += [(q, r, i, -t) for r, (t, i) in enumerate(s[:k], 1)]
    return sorted(out)


def vectors(n, dim=6, seed=1):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32).tolist()


@pytest.mark.parametrize("floats", [1, 50, tiles.TILE_FLOATS])
def test_knn_join(spark, monkeypatch, floats):
    monkeypatch.setattr(tiles, "TILE_FLOATS", floats)
    monkeypatch.setattr(tiles.packed, "__defaults__", (floats,))
    v = vectors(60)
    rows = list(enumerate(v)) + [(100, None), (None, v[0]), (101, [0.0] * 6), (102, [1.0, 2.0]), (103, v[3]), (104, v[3])]
    queries = [(i, v[i]) for i in range(0, 60, 7)] + [(500, None), (501, [0.0] * 6), (502, [1.0, 0.5]), (503, [1.0] * 9)]
    df, q = spark.createDataFrame(rows, VEC).repartition(3), spark.createDataFrame(queries, "qid long, embedding array<float>")
    got = sorted((r.qid, r.rank, r.vec_id, r.score) for r in tiles.knn_join(df, q, 5).collect())
    want = plain_knn(rows, queries, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-9)
    itself = sorted((r.qid, r.rank, r.vec_id) for r in tiles.knn_join(df, q, 5, but_itself=True).collect())
    assert itself == [w[:3] for w in plain_knn(rows, queries, 5, True)]


def test_knn_join_empty(spark):
    some, none = spark.createDataFrame([(1, [1.0])], VEC), spark.createDataFrame([], VEC)
    assert tiles.knn_join(none, some.withColumnRenamed("vec_id", "qid"), 3).collect() == []
    assert tiles.knn_join(some, none.withColumnRenamed("vec_id", "qid"), 3).collect() == []


def test_grid_covers_all_pairs():
    for a, b, t in ((1, 1, 16), (1000, 1, 16), (1, 1000, 16), (500, 300, 16), (7, 5, 64)):
        across, down = tiles.grid(a, b, t)
        assert 1 <= across <= a and 1 <= down <= b and a * b <= across * down * tiles.PAIRS * 2


def test_approximate_index(spark, monkeypatch):
    """All cells and all codes give the exact result; clustered data is found in few cells; a hot vector fills several blocks."""
    monkeypatch.setattr(ann, "ROWS", 16)
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 10))
    v = (middle[rng.integers(0, 12, 800)] + 0.1 * rng.normal(size=(800, 10))).astype(np.float32)
    v[::3] = v[0]
    rows = list(enumerate(v.tolist())) + [(900, None), (None, v[1].tolist())]
    queries = [(i, v[i].tolist()) for i in range(0, 800, 50)] + [(999, None)]
    df, q = spark.createDataFrame(rows, VEC).repartition(4), spark.createDataFrame(queries, "qid long, embedding array<float>")
    model = ann.fit(df, 5)
    path = ann.build(df, f"{shared_dir(spark)}/index", model)
    assert spark.read.parquet(f"{path}/codes").count() == spark.read.parquet(f"{path}/vectors").count() == 800
    whole = ann.search(spark, path, model, q, 5, probes=len(model.centres), refine=800)
    assert sorted((r.qid, r.rank, r.vec_id) for r in whole.hits.collect()) == [w[:3] for w in plain_knn(rows, queries, 5)]
    few = ann.search(spark, path, model, q, 5)
    assert few.probes < len(model.centres) and few.cells_read <= len(model.centres)
    true = {(q, i): s for q, _, i, s in plain_knn(rows, queries, 5)}
    found = {(r.qid, r.vec_id): r.score for r in few.hits.collect()}
    # with ties the neighbours may be others of the same score
    assert sum(s >= min(t for (q2, _), t in true.items() if q2 == q) - 1e-9 for (q, _), s in found.items()) >= 0.9 * len(true)
    one = ann.search(spark, path, model, q.filter("qid = 0"), 5, probes=1)
    assert one.cells_read == 1
    with pytest.raises(Exception, match="components"):
        ann.search(spark, path, model, spark.createDataFrame([(1, [1.0])], "qid long, embedding array<float>"), 5).hits.collect()
    assert ann.fit(spark.createDataFrame([], VEC)) is None


def test_pruned_to_the_probed_cells(spark):
    v = vectors(300, 8)
    df = spark.createDataFrame(list(enumerate(v)), VEC)
    model = ann.fit(df, 5)
    path = ann.build(df, f"{shared_dir(spark)}/index", model)
    codes = spark.read.schema("vec_id long, code binary, cell int").parquet(f"{path}/codes")
    plan = codes.filter(F.col("cell").isin([0]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


# ---------------------------------------------------------------- anchors

TEXTS = ["the cat sat on the mat", None, "", "cat", "a cat sat on\tthe mat today", "concatenate the\nmatter", "the  cat   sat", "x the cat sat on the ma y", "é ünder   the cat", "on the mat the cat sat", "the cat sat on the mat the cat sat on the mat"]
ANCHORS = ["cat", "cat sat", "the cat sat on the mat", "t sat on the m", "at", "c", " cat ", "the mat", "zebra", "", None, " ", "sat on the mat", "on\tthe mat", "a cat sat on\tthe mat today and more", "cat sat on", "the  cat", "ünder   the", "cat", "mat the cat sat", "catenate the\nmat"]


@pytest.mark.parametrize("most", [anchors.BROADCAST_BYTES, -1])
def test_anchors(spark, monkeypatch, most):
    monkeypatch.setattr(anchors, "BROADCAST_BYTES", most)
    docs = spark.createDataFrame([*enumerate(TEXTS), (3, "cat")], "doc_id long, text string").withColumn("gram", F.lit("clash"))
    asked = spark.createDataFrame([*enumerate(ANCHORS), (0, "cat")], "anchor_id long, anchor string").withColumn("text", F.lit("clash"))
    want = sorted((i, j) for i, a in enumerate(ANCHORS) for j, t in enumerate(TEXTS) if a and a.strip() and t and a in t)
    got = anchors.containment(asked.select("anchor_id", "anchor"), docs.select("doc_id", "text"))
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, anchors.containment(asked, docs).collect())) == want


def test_anchors_empty(spark):
    docs, asked = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "anchor_id long, anchor string")
    assert anchors.containment(asked.limit(0), docs).collect() == [] == anchors.containment(asked, docs.limit(0)).collect()


# ---------------------------------------------------------------- prefixes


def test_longest_prefix(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    openings = [(rng.choice("xyz"), word(rng.randrange(7)), rng.choice(["v", "w", None])) for _ in range(60)] + [("x", None, "v"), (None, "a", "v"), ("x", "é\U0001f600", "u")]
    rows = [(rng.choice("xyzq"), word(rng.randrange(9))) for _ in range(200)] + [("x", None), (None, "aa"), ("x", "é\U0001f600b"), ("x", ""), ("x", "aa"), ("x", "aa")]

    def plain(group, text):
        fits = [(len(o), o, v) for g, o, v in openings if g is not None and g == group and o is not None and text is not None and text.startswith(o)]
        if not fits:
            return None, None
        longest = max(fits, key=lambda f: f[0])[1]
        return longest, min((v for _, o, v in fits if o == longest and v is not None), default=None)

    df = spark.createDataFrame(rows, "source string, text string")
    got = prefixes.longest_prefix(df, spark.createDataFrame(openings, "source string, opening string, value string"), "source", "text")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((g, t, *plain(g, t)) for g, t in rows), key=repr)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- pacing

REQUEST = "key string, seq long, ready long, took long, limited boolean"


def plain_paced(rows, calls, per_s, cooldown_s):
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        at = None
        for _, seq, ready, took, limited in sorted((r for r in rows if r[0] == key and r[2] is not None), key=lambda r: (r[2], r[1])):
            start = ready if at is None else max(ready, at)
            out.append((key, seq, ready, start, start - ready))
            at = start + max(round(per_s * 1e6 / calls), (took or 0) + (round(cooldown_s * 1e6) if limited else 0))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 13])
def test_paced(spark, partitions):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), i, rng.randrange(0, 900) * 1_000_000, rng.randrange(0, 9_000_000), rng.random() < 0.1) for i in range(500)]
    rows += [("a", 1000, 5_000_000, None, None), ("a", 1001, 5_000_000, 0, True), (None, 1, 1, 1, True), ("a", 1002, None, 1, True), ("alone", 1, 7, 7, True)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = pacing.paced(spark.createDataFrame(rows, REQUEST), 20, 60, 30)
        assert sorted(map(tuple, got.collect())) == plain_paced(rows, 20, 60, 30)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert pacing.paced(spark.createDataFrame([], REQUEST), 20).collect() == []


# ---------------------------------------------------------------- the breaker as a stream

ATTEMPT = "key long, seq long, ts timestamp, failure boolean"


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def streamed(spark, batches, **options):
    """Stops after each batch has landed and the query has gone on from its checkpoint."""
    top, out = shared_dir(spark), []
    for rows in batches:
        spark.createDataFrame(rows, ATTEMPT).coalesce(1).write.mode("append").parquet(f"{top}/in")
        breaker.start(spark.readStream.schema(ATTEMPT).parquet(f"{top}/in"), f"{top}/out", f"{top}/checkpoint", **options).awaitTermination()
        out.append(sorted((r.key, r.stop_at) for r in spark.read.schema(breaker.STOPPED).parquet(f"{top}/out").collect()))
    return out


def test_breaker_stream_restarts(spark):
    """Runs go on across batches and restarts; a success, null included, ends them; a key stops once."""
    fail = lambda key, seq: (key, seq, at(seq), True)
    batches = [[fail(2, 2), fail(1, 1), fail(1, 0), (3, 5, at(5), None), (None, 6, at(6), True)], [(1, 10, at(10), False), fail(2, 11), fail(3, 12), fail(3, 13)], [fail(1, 20), fail(1, 21), fail(2, 22), fail(3, 24)], [fail(1, 30), fail(1, 31), fail(1, 32), fail(2, 33), fail(2, 34)]]
    assert streamed(spark, batches, limit=3) == [[], [], [(2, 3), (3, 4)], [(1, 6), (2, 3), (3, 4)]]


def test_breaker_stream_timer(spark):
    """A key quiet for longer than a minute of event time is closed: its failures before don't count."""
    quiet = [[(1, 0, at(0), True), (1, 1, at(1), True)], [(9, 2, at(500), False)], [(9, 3, at(600), False)], [(1, 4, at(700), True)], [(1, 5, at(701), True), (1, 6, at(702), True)]]
    assert streamed(spark, quiet, limit=3, idle_s=60)[-1] == [(1, 3)]
    assert streamed(spark, quiet, limit=3)[-1] == [(1, 3)]
    busy = [[(1, 0, at(0), True), (1, 1, at(1), True)], [(9, 2, at(30), False)], [(1, 4, at(40), True)]]
    assert streamed(spark, busy, limit=3, idle_s=60)[-1] == [(1, 3)]
    after = [*quiet[:4], [(9, 9, at(710), False)]]
    assert streamed(spark, after, limit=3, idle_s=60)[-1] == [] and streamed(spark, after, limit=3)[-1] == [(1, 3)]


# ---------------------------------------------------------------- the learned encoder


def dense(texts, model_idf):
    a = np.zeros((len(texts), len(model_idf)))
    for row, t in zip(a, texts, strict=True):
        at, n = latent.counts(t, len(model_idf))
        if at:
            row[at] = latent.weighted(at, n, model_idf)
    return a


def test_latent_equals_numpy(spark, monkeypatch):
    """Singular values and vectors of a matrix with a clear spectrum, as numpy finds them; small blocks, odd texts."""
    monkeypatch.setattr(latent, "BLOCK_FLOATS", 1)
    rng = random.Random(2)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(6)]
    texts = [" ".join(rng.choice(topics[k]) for _ in range(5 + 10 * (6 - k)) for _ in range(1)) + " shared" for k in range(6) for _ in range(40 - 6 * k)]
    texts += [None, "", "...", texts[0], "Ünder ünder"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("weight", F.lit("clash")).repartition(5)
    model = latent.fit(docs, 5, passes=30, buckets=512)
    want_df = np.zeros(512)
    for t in texts:
        want_df[latent.counts(t, 512)[0]] += 1
    total = sum(bool(latent.counts(t, 512)[0]) for t in texts)
    assert total == len(texts) - 3 and np.allclose(model.idf, np.log((1 + total) / (1 + want_df)) + 1)
    a = dense(texts, model.idf)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values, s[:5], rtol=1e-6)
    assert np.allclose(model.vectors.T @ model.vectors, np.eye(5), atol=1e-9)
    assert np.allclose(np.abs(np.diag(vt[:5] @ model.vectors)), 1, atol=1e-4)
    assert (model.vectors[np.abs(model.vectors).argmax(0), np.arange(5)] > 0).all()
    got = latent.encode(model)(texts)
    want = a @ model.vectors
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.where(norm == 0, 1, norm), atol=1e-5)
    assert not got[-5:-2].any()
    few = latent.fit(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string"), 5, buckets=64)
    assert len(few.values) == 1
    assert latent.fit(docs.limit(0), 5) is None


# ---------------------------------------------------------------- pages in rows of their own


@pytest.mark.parametrize("partitions", [1, 7])
def test_pages_in_rows(spark, partitions):
    """As the documents in one row each: running heads, margin numbers, and notes whose numbers go on over pages and ranges."""
    rng = random.Random(partitions)

    def page(i):
        lines = [f"No. 22 Page {i}" if rng.random() < 0.8 else "", *(rng.choice(["", "words of a line that is hy-", "more words", "_____", f"{rng.randrange(1, 9)} note text", f" {rng.randrange(1, 5)}", "12"]) for _ in range(rng.randrange(9))), f"  {i}" if rng.random() < 0.5 else "end"]
        return "\n".join(lines)

    docs = [(f"d{k}", "\f".join(page(i) for i in range(rng.randrange(1, 30)))) for k in range(14)]
    docs += [("hot", "\f".join(f"body {'abcdefg'[n % 7] * n}\n{n} a note\nmore {'hijk'[n % 4] * n}" for n in range(1, 101))), ("margins", "\f".join("\n".join(f" {i}   line {i}" for i in range(1, 9)) for _ in range(3))), ("null", None), ("blank", "\n\f \n"), ("one", "x")]
    df = spark.createDataFrame(docs, "source_id string, text string")
    table = pages.pages(df.fillna("", "text")).withColumn("lines", F.lit("clash")).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(pages.clean_pages(table).collect(), key=lambda r: (r.source_id, r.page_no))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {r.source_id: r for r in pages.clean(df).collect()}
    assert {r.source_id for r in got} == set(want)
    for source, w in want.items():
        mine = [r for r in got if r.source_id == source]
        assert [x for r in mine for x in r.lines] == w.lines, source
        assert [n for r in mine for n in r.notes] == list(range(1, w.footnotes + 1))
        assert [r.page_no for r in mine] == list(range(w.pages))
    assert want["hot"].footnotes == 99


def test_many_queries_meet_tiles(spark, monkeypatch):
    """Beyond a block of queries none passes through the driver; no product is larger than a block of either side."""
    monkeypatch.setattr(search, "BLOCK_ROWS", 7)
    monkeypatch.setattr(tiles, "TILE_ROWS", 16)
    v = vectors(90)
    rows = list(enumerate(v)) + [(100, None), (None, v[0]), (102, [1.0, 2.0]), (103, v[3])]
    df = spark.createDataFrame(rows, VEC).repartition(3)
    sizes = []
    join = tiles.knn_join
    monkeypatch.setattr(tiles, "knn_join", lambda *a, **k: sizes.append(1) or join(*a, **k))
    for n in (5, 60):
        queries = [(i, v[i]) for i in range(n)]
        got = search.search(df, spark.createDataFrame(queries, "qid long, embedding array<float>"), 5).collect()
        assert sorted((r.qid, r.rank, r.vec_id) for r in got) == [w[:3] for w in plain_knn(rows, queries, 5)]
        assert len(sizes) == (n > 7)


def test_best_takes_blocks(monkeypatch):
    """Blocks of ids give the same as all at once; ties by id, -inf and nan never count."""
    rng = np.random.default_rng(4)
    s = np.round(rng.normal(size=(9, 200)), 1)
    s[0, :50], s[1] = np.nan, -np.inf
    ids = rng.permutation(200)
    found = tiles.Best(9, 6)
    for i in range(0, 200, 30):
        found.add(s[:, i : i + 30], ids[i : i + 30])
    for q in range(9):
        want = sorted((-x, i) for x, i in zip(s[q], ids, strict=True) if np.isfinite(x))[:6]
        assert [(-x, i) for x, i in zip(found.scores[q], found.ids[q], strict=True) if np.isfinite(x)] == want


def test_packed_tiles_are_bounded(spark):
    got = tiles.packed(spark.createDataFrame([(i, [1.0]) for i in range(3000)], VEC).coalesce(1)).select("n").collect()
    assert max(r.n for r in got) == tiles.TILE_ROWS and sum(r.n for r in got) == 3000


def test_encoders_get_bounded_pieces(spark, monkeypatch):
    """Neither rows nor bytes of a batch reach an encoder at once; the vectors are those of all texts together."""
    from tessera.operators import encoding

    texts = pa.array(["a" * n for n in (5, 5, 5, 40, 3)] + [None, ""] + ["x y"] * 20)
    monkeypatch.setattr(encoding, "ROWS", 8)
    monkeypatch.setattr(encoding, "BYTES", 12)
    cut = list(encoding.pieces(texts))
    assert [i for i, n in cut for i in range(i, i + n)] == list(range(len(texts)))
    assert all(n == 1 or sum(len(t or "") for t in texts.slice(i, n).to_pylist()) <= 12 for i, n in cut) and max(n for _, n in cut) <= 8
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "i int, t string").coalesce(1)

    def encode(some):
        assert len(some) <= 512
        return encoding.hashing(some)

    monkeypatch.undo()
    many = df.crossJoin(spark.range(60).select("id").coalesce(1)).coalesce(1)
    got = many.select("t", encoding.encoder(encode)("t").alias("v")).collect()
    assert len(got) == 27 * 60 and all(np.allclose(r.v, encoding.hashing([r.t])[0], atol=1e-6) for r in got[::7])


def test_latent_sums_in_bounded_tasks(spark, monkeypatch):
    """However many files the rows have, a pass runs in as many tasks as there are cores times ``TASKS``: each task's sum has the model's size."""
    docs = spark.createDataFrame([(i, f"w{i % 7} v{i % 5}") for i in range(200)], "doc_id long, text string").repartition(40)
    seen = []
    real = latent._added

    def added(sparse, idf, g):
        out, coalesced = real(sparse, idf, g), []
        monkeypatch.setattr(type(sparse), "coalesce", lambda self, n, c=type(sparse).coalesce: coalesced.append(n) or c(self, n))
        assert np.allclose(real(sparse, idf, g), out)
        monkeypatch.undo()
        seen.extend(coalesced)
        return out

    monkeypatch.setattr(latent, "_added", added)
    latent.fit(docs, 3, passes=1, buckets=64)
    assert seen and max(seen) == latent.TASKS * spark.sparkContext.defaultParallelism


def test_strip_furniture_moves_no_text(spark):
    """Documents of one row aren't shuffled; rows that share an id are one document, page by page."""
    rng = random.Random(5)
    page = lambda i: "\n".join([f"HEAD {i}", *(rng.choice(["text here", "", "_____", "12", "- 3 -"]) for _ in range(4)), f"{i}"])
    texts = ["\f".join(page(i) for i in range(n)) for n in (1, 3, 7, 12)] + ["", "\f\n\f", None]
    once = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "source_id string, text string")
    twice = once.union(spark.createDataFrame([("d1", texts[2]), (None, texts[1])], once.schema))
    plan = pages.strip_furniture(once)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    rows = lambda df: sorted(map(tuple, df.collect()))
    for df in (once, twice):
        assert rows(pages.strip_furniture(df)) == rows(pages._stripped_together(df.filter("source_id is not null")))
    assert rows(pages.strip_furniture(once))


def test_running_heads_of_many_pages(spark):
    """The ends of a document's pages are keyed once, not once for each other."""
    import time

    text = "\f".join(f"Case {chr(65 + i % 26)}{chr(65 + i // 26 % 26)}{chr(65 + i // 676)} of the day\nbody\nsame foot {i}" for i in range(4000))
    began = time.monotonic()
    r = pages.clean(spark.createDataFrame([("x", text)], "source_id string, text string")).first()
    assert (r.running_heads, r.pages, len(r.lines)) == (["same foot #"], 4000, 4000)
    assert time.monotonic() - began < 20


def test_probed_cells_leave_in_bounded_batches(monkeypatch):
    """A batch of queries times its probed cells is never held at once."""
    rng = np.random.default_rng(3)
    model = ann.Model(ann._unit(rng.normal(size=(40, 8))), np.zeros((2, ann.CODES, ann.GROUP)), 8, 30)
    ran = []

    class Rows:
        def filter(self, *_):
            return self

        select = filter

        def mapInArrow(self, run, schema):
            ran.append(run)

    ann._probed(Rows(), model, 30)
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(rng.normal(size=(700, 8)).tolist())], ["qid", "embedding"])
    got = list(ran[0](iter([batch])))
    assert sum(b.num_rows for b in got) == 700 * 30 and max(b.num_rows for b in got) <= ann.ROWS
    assert sorted({q for b in got for q in b.column(1).to_pylist()}) == list(range(700))


def test_pleading_paper_moves_no_lines(spark):
    """What pages say of pleading paper is shuffled as numbers, without their text."""
    df = spark.createDataFrame([("a", 0, " 1  x\n 2  y\n"), ("a", 1, "\f 3  z\nw")], "source_id string, page_no int, shut string")
    got = pages._pleading(df)
    assert [tuple(r) for r in got.collect()] == [("a", True)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "own#" not in plan[: plan.index("Window")]  # parents of the window come first


def test_anchors_move_no_text_by_question(spark):
    """Texts are shuffled once, to meet the anchors that are sought in them; nothing with a text is dealt out by question."""
    from tessera.operators import scoring

    texts = [(s, i, f"text {s} {i} holds w{s}x{i}") for s in range(4) for i in range(5)]
    chunks = spark.createDataFrame([*texts, (4, 0, None)], "source_id long, chunk_index int, text string")
    hits = spark.createDataFrame([(q, r, (q + r) % 5, r % 5 if (q + r) % 5 < 4 else 0, 5 if (q + r) % 5 < 4 else 1) for q in range(6) for r in range(1, 4)], "qid long, rank int, source_id long, chunk_index int, chunk_total int")
    anchors = [(q, p, a) for q in range(7) for p, a in enumerate(("w1x1", f"w{q}x2", "nowhere", None))] + [(0, 0, "w1x1"), (1, None, "text")]
    keys = spark.createDataFrame(anchors, "qid long, position int, anchor string")
    at, want = {(s, i): t for s, i, t in texts}, set()
    for q, p, a in anchors:
        own = [(h.source_id, h.chunk_index) for h in hits.collect() if h.qid == q]
        has = lambda *c, a=a: a is not None and a in at.get(c, "")
        want.add((q, p, a, any(has(*c) for c in own), any(has(s, i + d) for s, i in own for d in (-1, 0, 1))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = scoring.anchors_found(hits, chunks, keys)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len(want)
    assert set(got) == want
    moved = [x for x in plan.split("\n\n") if ") Exchange" in x and "text#" in x]
    assert len(moved) == 1
    assert "source_id" in moved[0].split("Arguments:")[1]
