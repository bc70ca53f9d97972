"""Quality rules, spelling variants and hard negatives: against SQL over whole tables, plain restatements, odd rows."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, quality_rules, spelling
from tessera.llm.common import saved, scratch_dir

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def rows(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_as_sql(spark, op, sql, table, data=DATA):
    df = spark.read.parquet(f"{data}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{data}/{table}.parquet'")
    got = op(df)
    want = con.sql(sql)
    assert rows(got.select(*sorted(got.columns))) == sorted((tuple(r) for r in con.sql(f"select {', '.join(sorted(want.columns))} from ({sql})").fetchall()), key=repr)
    return got


# ---------------------------------------------------------------- quality rules


def plain_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if grams[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_sql(spark):
    same_as_sql(spark, quality_rules.op12, quality_rules.ORACLE, "documents")


ODD = [None, "", " \t\n\x0b\f\r", "a b", "a b c", "a b c a b c", "x " * 60, "a b c d a b c d e a b c", "l1\nl1\n \nl2\nl1", "#*$%&|<> é\U0001f600   x", ("w%d " * 3000) % tuple(i % 700 for i in range(3000)), "one two three " * 20000]


@pytest.mark.parametrize("bits", [quality_rules.PLACE_BITS, 60])
def test_rules_counts(spark, monkeypatch, bits):
    """With 60 bits for the place, four are left for the hash: windows clash and are counted by their words."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", bits)
    df = spark.createDataFrame(list(enumerate(ODD)) + [(3, "a b"), (None, "a b c a b c")], DOC).withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.op12(df).collect()}
    assert {i: got[i] for i in range(len(ODD))} == {i: plain_rules(t) for i, t in enumerate(ODD)}
    assert got[None] == (6, 6, 0, 0, 6)
    assert quality_rules.op12(df).count() == len(ODD) + 2


def test_rules_empty(spark):
    assert quality_rules.op12(spark.createDataFrame([], DOC)).collect() == []


def test_cascade_order_and_verdict(spark):
    """Order is by rejection per second, whatever it is the verdict stays, and later rules see only what earlier ones passed."""
    r = [quality_rules.Rule(n, F.lit(True)) for n in "abcd"]
    m = [quality_rules.Measure("a", 2.0, 0.5), quality_rules.Measure("b", 1.0, 0.5), quality_rules.Measure("c", 0.1, 0.0), quality_rules.Measure("d", 0.01, 0.4)]
    assert [x.name for x in quality_rules.ordered(r, m)] == ["d", "b", "a", "c"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    counted = saved(quality_rules.statistics(docs), f"{scratch_dir(spark)}/counted")
    verdicts = [{x.doc_id: x.failed_rule is None for x in quality_rules.cascade(counted, some).collect()} for some in (quality_rules.rules(), quality_rules.rules()[::-1])]
    assert verdicts[0] == verdicts[1]
    by_sample = {x.doc_id: x.failed_rule is None for x in quality_rules.cascade(counted, quality_rules.rules(), counted).collect()}
    assert by_sample == verdicts[0]
    # a rule that fails on every row it sees is never reached behind one that rejects all
    boom = quality_rules.Rule("boom", F.raise_error(F.lit("evaluated")).cast("boolean"))
    assert {x.failed_rule for x in quality_rules.cascade(counted, [quality_rules.Rule("all", F.col("n_words") >= 0), boom]).collect()} == {"all"}
    assert {x.failed_rule for x in quality_rules.cascade(counted, []).collect()} == {None}
    measures = {x.name: x for x in quality_rules.measured(counted, quality_rules.rules(), 1)}
    assert measures["base"].rejected == sum(1 for x in counted.select(quality_rules.base_failed()).collect() if x[0]) / counted.count()


def test_rules_are_native(spark):
    plan = quality_rules.op12(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---------------------------------------------------------------- spelling variants


def plain_variants(docs):
    import re

    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def one(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in n if one(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n), key=repr)


def test_spelling_sql(spark):
    same_as_sql(spark, spelling.op11, spelling.ORACLE, "documents")


def test_spelling_plain(spark):
    base = "colour"
    words = [base] * 700 + ["color"] * 99 + ["colours"] * 130 + ["coulours"] * 25 + ["couulours"] * 5 + ["COLOUR"] * 3 + ["cölour"] * 6 + ["cölöur"] * 5 + ["Éclairé"] * 7 + ["aabbcc"] * 30 + ["abbccc"] * 6 + ["aabbccc"] * 6 + ["bababa"] * 5 + ["ababab"] * 5 + ["abcdef"] * 5 + ["abcdxf"] * 5 + ["abcdyf"] * 25
    docs = [(i, " ".join(words[i::7]) + " tail123mid_dle") for i in range(7)] + [(None, "colour abcdef"), (8, None), (8, ""), (9, "1234"), (9, "longest" * 3000), (10, "colour " * 3), (10, "colour " * 3)]
    df = spark.createDataFrame(docs, DOC).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = rows(spelling.op11(df))
    assert got == plain_variants(docs)
    chain = {r[0]: r[1:3] for r in got}
    assert chain["coulours"] == ("colours", "colour") and chain["couulours"] == ("coulours", "colour")


def test_near_pairs_come_once(spark):
    """All words over two letters up to length 7, of which many share several deletions."""
    import itertools

    words = ["".join(w) for k in range(1, 8) for w in itertools.product("ab", repeat=k)]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    pairs = [(r.word, r.other) for r in spelling.near(df).collect()]
    con = duckdb.connect()
    con.sql("create table w as select unnest(?) as w", params=[words])
    assert sorted(pairs) == sorted(con.sql("select a.w, b.w from w a join w b on levenshtein(a.w, b.w) = 1").fetchall())


def test_spelling_empty(spark):
    assert spelling.op11(spark.createDataFrame([], DOC)).collect() == []
    assert spelling.op11(spark.createDataFrame([(1, "rare words only here")], DOC)).collect() == []


# ---------------------------------------------------------------- hard negatives

VEC = "vec_id long, embedding array<float>, label int"


def plain_negatives(table, every=100):
    live = []
    for i, v, label in table:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        live.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for k, (i, v, label) in enumerate(live):
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j, o, lab) for o, (j, w, lab) in enumerate(live) if o != k))
        for s, j, _, _ in [x for x in scored if x[3] == label][:5]:
            fits = [x for x in scored if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out, key=repr)


def test_negatives_sql(spark):
    assert same_as_sql(spark, hard_negatives.op13, hard_negatives.ORACLE, "embeddings").count() > 0


def vectors(n, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)).astype(np.float32) + rng.integers(0, 4, (n, 1))


def test_negatives_plain(spark, monkeypatch):
    """Small cells and packs, a vector that a third of the rows share, ties, odd rows, clashing columns."""
    monkeypatch.setattr(hard_negatives, "CELL_FLOATS", 0)
    monkeypatch.setattr(hard_negatives, "PACK_FLOATS", 0)
    v = vectors(900)
    v[::3] = v[0]
    table = [(i, v[i].tolist(), int(i * 7 % 10)) for i in range(900)]
    table += [(100, None, 1), (200, v[1].tolist(), None), (None, v[2].tolist(), 1), (300, [float("nan")] * 12, 1), (400, [None] + [1.0] * 11, 1), (500, [float("inf")] * 12, 2), (0, v[0].tolist(), 0), (101, v[1].tolist(), 3), (101, v[1].tolist(), 3), (7700, [0.0] * 12, 4), (7800, [1.5] * 5, 4), (7900, [], 4), (8000, [-x for x in v[5].tolist()], 5)]
    df = spark.createDataFrame(table, VEC).withColumn("row", F.lit(1)).withColumn("score", F.lit("clash")).repartition(5)
    got = hard_negatives.op13(df)
    assert rows(got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) == plain_negatives(table)


def test_search_takes_several_rounds(spark, monkeypatch):
    """A radius far too small at first: it grows until every query is certified, and nothing is found twice."""
    own = hard_negatives.build
    monkeypatch.setattr(hard_negatives, "build", lambda *a: (lambda x: x and x._replace(start=1e-3))(own(*a)))
    monkeypatch.setattr(hard_negatives, "CELL_FLOATS", 0)
    v = vectors(400, 3, 9)
    table = [(i, v[i].tolist(), i % 2) for i in range(400)]
    got = hard_negatives.op13(spark.createDataFrame(table, VEC))
    assert rows(got) == plain_negatives(table)


def test_negatives_without_partners(spark):
    assert hard_negatives.op13(spark.createDataFrame([], VEC)).collect() == []
    assert hard_negatives.op13(spark.createDataFrame([(100, None, 1)], VEC)).collect() == []
    assert hard_negatives.op13(spark.createDataFrame([(100, [1.0, 2.0], 1)], VEC)).collect() == []
    assert hard_negatives.op13(spark.createDataFrame([(i, [1.0, float(i)], 1) for i in range(1, 60)], VEC)).collect() == []
    # fewer positives and negatives than asked for: all of them
    few = [(100, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.1], 2), (3, [1.0, 0.25], 2), (4, [-1.0, 0.0], 3)]
    assert rows(hard_negatives.op13(spark.createDataFrame(few, VEC))) == plain_negatives(few)
