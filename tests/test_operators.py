"""Operators against plain restatements."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import chunking, encoding, evaluation, footnotes, markup, pages, search, windows
from tessera.plans import answering, catalogue, catalogue_more
from tessera.plans.fixtures import frame


def headed_text(R):
    kinds = (
        lambda: "#" * R.randint(1, 5) + " " + " ".join(R.choice(["A", "Bx", "C."]) for _ in range(R.randint(0, 3))),
        lambda: " ".join(R.choice(["w", "end.", '"go."', "x,y", "(a)", "z;"]) for _ in range(R.randint(200, 500))),
        lambda: "w " * R.randint(250, 600),
        lambda: R.choice(["", " ", "\t"]),
        *[lambda: " ".join(R.choice(["w", "end.", "[^ 3]", "x,y", "z;"]) for _ in range(R.randint(1, 130)))] * 5,
    )
    return "\n".join(R.choice(kinds)() for _ in range(R.randint(0, 40)))


def test_chunks_of_headed_texts_against_sql(spark):
    R = random.Random(3)
    rows = [(i, headed_text(R)) for i in range(60)]
    got = chunking.chunks(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    docs = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(catalogue.chunk_sql("docs")).df()
    canon = lambda df: sorted((r.doc_id, r.chunk_index, r.chunk_total, r.text, r.tokens, r.section, tuple(r.footnote_numbers)) for r in df.itertuples())
    assert len(got) > 300
    assert canon(got) == canon(want)
    assert got.tokens.max() <= chunking.TOKEN_CEILING


def test_long_line_splits(spark):
    line = 'He said "go." ' + "word " * 300 + ". End"
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    pieces = one(chunking.split_long(F.lit(line)))
    assert [len(p.split()) for p in pieces] == [3, 256, 45, 1]
    short, nine = F.lit('say "go." Then it went'), lambda c: F.lit(9)
    assert one(chunking.split_long(short, nine)) == ['say "go.', "Then it went"]
    assert one(chunking.split_long(short, nine, keep_closers=True))[0] == 'say "go."'
    by_letter = chunking.chunks(spark.createDataFrame([(1, "aaa\n" * 100)], "doc_id long, text string"), count=F.length)
    assert by_letter.agg(F.max("tokens")).first()[0] == 219


def test_chunks_handle_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, " \n "), (3, "a\nb"), (None, "x [^ 4] y")], "doc_id long, text string")
    got = {(r.doc_id, r.text): r for r in chunking.chunks(df).collect()}
    assert set(got) == {(3, "a\nb"), (None, "x [^ 4] y")}
    assert got[(None, "x [^ 4] y")].footnote_numbers == [4]


def test_search_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[7] = x[5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>").repartition(5)
    q = df.filter("vec_id < 10").withColumnRenamed("vec_id", "qid")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = search.search(df, q, 5).orderBy("qid", "rank").collect()
    for i in range(10):
        s = np.round(u @ u[i], 9)
        want = sorted(range(300), key=lambda j: (-s[j], j))[:5]
        assert [r.vec_id for r in got if r.qid == i] == want


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert search.search(empty, empty.withColumnRenamed("vec_id", "qid")).count() == 0


def test_cap_is_the_greedy_scan(spark):
    R = random.Random(3)
    rows = [(q, r, R.choice("abc")) for q in range(20) for r in range(1, 15)]
    got = search.capped(spark.createDataFrame(rows, "qid int, rank int, source string"), 2, 5).collect()
    for q in range(20):
        seen, want = {}, []
        for _, r, s in [x for x in rows if x[0] == q]:
            if seen.get(s, 0) < 2 and len(want) < 5:
                want.append(s)
                seen[s] = seen.get(s, 0) + 1
        assert [x.source for x in sorted((g for g in got if g.qid == q), key=lambda g: g.rank)] == want


def test_source_blocks(spark):
    got = {(r.qid, r.rank): r.text for r in windows.source_blocks(frame(spark, "hits"), frame(spark, "hit_chunks")).collect()}
    assert got[(1, 1)] == "alpha zero\nalpha one " + "c" * 50
    assert got[(1, 2)] == "alpha two"  # carried over from the block before
    assert got[(1, 4)] == "alpha three"
    assert got[(2, 1)] == "beta"


def test_process_chapter(spark):
    raw = spark.createDataFrame([("d", "[ALERT] USCIS has updated Volume 7\nText [1] and [2]​ here [8].\n[ALERT] unseen\n## Footnotes\n[^ 1] See INA 319.\n[^ 2] Officers weigh evidence\ncarefully again\n[^ 2] Another reviewed duplicate note")], "source_id string, text string")
    r = footnotes.process_chapter(raw, frame(spark, "verdicts")).first()
    assert r.text == "Text and [2] here.\n[^ 2] Officers weigh evidence carefully again\nunseen\n[^ 2] Another reviewed duplicate note"
    assert (r.orphan_markers, r.duplicate_definitions, r.footnotes_kept, r.footnotes_dropped, r.unreviewed_alerts) == ([8], [2], 2, 1, ["unseen"])


def test_place_in_mark_order(spark):
    docs = spark.createDataFrame([("x", ["both [2] then [1] and [2]"], {1: "one", 2: "two"}, {1: "one", 2: "two"})], "source_id string, body array<string>, notes map<int,string>, kept map<int,string>")
    r = footnotes.place(docs).first()
    assert r.lines == ["both [2] then [1] and [2]", "[^ 2] two", "[^ 1] one", "[^ 2] two"]


def test_pages(spark):
    text = "\f".join(f"HEAD {i}\nBody {i} wraps-\nround.\n{n}\n{i}" for i, n in ((1, "text"), (2, "1 First\nnote"), (3, "2 Second"), (4, "9 U.S.C.")))
    r = pages.clean(spark.createDataFrame([("x", text), ("none", None)], "source_id string, text string")).filter("source_id = 'x'").first()
    assert r.lines == ["Body 1 wraps-round. text", "Body 2 wraps-round.", "[^ 1] First note", "Body 3 wraps-round.", "[^ 2] Second", "Body 4 wraps-round. 9 U.S.C."]
    assert (r.pages, r.pleading_paper, r.running_heads, r.footnotes) == (4, False, ["#", "HEAD #"], 2)


def test_pages_match_the_distributed_heads(spark):
    df = frame(spark, "paged")
    heads = {}
    for r in pages.running_heads(df).collect():
        heads.setdefault(r.source_id, []).append(r.key)
    for r in pages.clean(df).collect():
        assert sorted(heads.get(r.source_id, [])) == r.running_heads


HTML = '<div id="guidance"><div class="x field--name-body"><h2>A  title</h2><p>One <b>bold</b> , two<p>open<ul><li>a<ul><li>b</ul></ul><table><caption>Cap</caption><tr><th>h<td>1</table><div class="alert-message"><div><p>Beware</p></div></div><hr><video></video></div></div>'


def test_chapter_html():
    lines, unhandled, error = markup.parse_chapter(HTML)
    assert lines == ["## A title", "One bold, two", "open", "- a b", "- b", "Cap", "| h | 1 |", "[ALERT] Beware"]
    assert (unhandled, error) == (["video"], None)
    assert markup.parse_chapter("<p>x")[2] == "structure_changed"
    assert markup.parse_chapter(None)[2] == "structure_changed"


def part(title, chapters, link=True):
    items = "".join(f'<li class="level__item--4">{c}</li>' for c in chapters)
    head = f'<a href="/p">{title}</a>' if link else title
    return f'<div class="level--3"><ul><li class="level__item--3">{head}</li></ul><ul class="level--4">{items}</ul></div>'


def volume(title):
    return f'<div class="level--2"><div class="level__title"><a href="/v">{title}</a></div></div>'


def test_contents():
    toc = "<main>" + volume("Volume 12 - B") + part("Part A", ['<a href="/z">Chapter 1</a>']) + volume("Volume 1 - A") + part("Part B - x", ['<a href="/c1">Chapter 1</a>', "Chapter 2"]) + part("Part C", ['<a href="/c3">Chapter 1</a>']) + part("Part D", [], link=False) + "</main>"
    assert markup.contents(toc, "Volume 1", ["Part B"]) == [("Volume 1", "Volume 1 - A", "Part B - x", "Chapter 1", "/c1")]
    assert [x[4] for x in markup.contents(toc, "Volume 1")] == ["/c1", "/c3"]
    assert [x[4] for x in markup.contents(toc, "Volume 12")] == ["/z"]
    with pytest.raises(markup.StructureChanged):
        markup.contents(toc, "Volume 1", ["Part Z"])
    with pytest.raises(markup.StructureChanged):
        markup.contents(toc, "Volume 2")


def test_opinion_xml(spark):
    xml = '<o><opinion><author>X, J.</author><p>Castr<em>acani</em> held<footnotemark>1</footnotemark> so <page-number>*9</page-number>far.</p><blockquote>q</blockquote><table/><footnote label="1"><p>. A note.</p></footnote><footnote label="x">no</footnote></opinion></o>'
    body, notes, unknown, error = markup.parse_opinion(xml)
    assert body == ["X, J.", "Castracani held1 so far.", "> q"]
    assert (notes, unknown, error) == ({1: "A note."}, {"table": 1}, None)
    placed = footnotes.place(spark.createDataFrame([("o", body, notes, notes)], "source_id string, body array<string>, notes map<int,string>, kept map<int,string>"), mark=markup.PRIVATE_MARK).first()
    assert placed.lines[2] == "[^ 1] A note."
    assert markup.parse_opinion("<broken")[3] == "bad_xml"


def test_containment(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, "cat")], "doc_id long, text string")
    anchors = spark.createDataFrame([(10, "cat"), (11, "cat sat"), (12, ""), (13, None), (14, "dog"), (15, "cat")], "anchor_id long, anchor string")
    got = {(r.anchor_id, r.doc_id) for r in evaluation.anchor_containment(anchors, docs).collect()}
    assert got == {(10, 1), (10, 3), (11, 1), (15, 1), (15, 3)}


def test_answer_key_numbers_hold(spark):
    """Numbers of anchors and documents are the same wherever they are used, however rows are dealt when the checks run."""
    texts = [f"word{i} and then number{i} stands here for once" for i in range(40)]
    documents = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "source_id string, text string")
    asked = [(f"q{i}", [(f"d{(i + 1) % 40}", [texts[i][:20]])], []) for i in range(40)]
    questions = spark.createDataFrame(asked, "id string, expected array<struct<source_id string, anchors array<string>>>, acceptable array<string>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        problems = evaluation.validate(questions, documents, documents)
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        got = {(r.id, r.detail) for r in problems.filter("problem = 'anchor_elsewhere'").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(f"q{i}", f"{texts[i][:20]}@d{i}") for i in range(40)}


def test_encoder(spark):
    v = encoding.hashing(["a b", "", "a b"])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0, 1])
    assert np.array_equal(v[0], v[2])
    got = spark.createDataFrame([("a b",), (None,)], "t string").select(encoding.encoder()(F.col("t")).alias("e")).collect()
    assert np.allclose(got[0].e, v[0])


@pytest.mark.parametrize("n", [1, 4, 5, 10])
def test_order_statistics(spark, n):
    r = chunking.size_stats(spark.createDataFrame([(i * 7 % 13,) for i in range(n)], "tokens long")).first()
    x = sorted(i * 7 % 13 for i in range(n))
    assert (r.median, r.p10, r.p90, r.largest) == (x[n // 2], x[int(n * 0.1)], x[int(n * 0.9)], x[-1])


def test_providers(spark):
    asked, shown = frame(spark, "asked"), catalogue_more._about(spark, "")
    with pytest.raises(ValueError, match="outside the engine"):
        answering.generate(asked, shown, provider="gemini")
    local = lambda p: p.withColumn("response", F.lit('{"response": "Yes [S1] [S9].", "done": true, "eval_count": 3}'))
    got = {r.qid: r for r in answering.generate(asked, shown, local, "local").collect()}
    assert (got[1].answer, got[1].cited, got[1].unknown, got[1].citations) == ("Yes [S1] [S9].", ["S1"], ["S9"], 1)
    assert (got[3].answer, got[3].degraded_category) == (None, "no_sources")
    broken = answering.generate(asked, shown, lambda p: p.withColumn("response", F.lit("oops"))).filter("qid = 1").first()
    assert (broken.answer, broken.degraded_category, broken.citations) == (None, "bad_json", 0)


def test_unknown_tag_names_the_known(spark):
    index = frame(spark, "tagged")
    with pytest.raises(ValueError, match="tagged values: .*character.*delay"):
        search.checked_filter(index, "caselaw", "nope")
    assert index.filter(search.checked_filter(index, None, "character")).count() == 1
    assert search.checked_filter(index) is None
