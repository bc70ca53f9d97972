"""Every query of the library against its SQL in DuckDB, over whole tables of the smallest scale."""

import collections
import math
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from tessera.operators.encoding import hashing
from tessera.plans import catalogue, catalogue_more, catalogue_scale  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(df: pd.DataFrame) -> list:
    def f(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return tuple(map(f, v))
        if isinstance(v, dict):
            return tuple(sorted((k, f(x)) for k, x in v.items()))
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(round(v, 9)) if isinstance(v, float) else v

    return sorted((tuple(f(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(catalogue.CASE_SQL))
def test_typed_rows_against_sql(spark, duck, name):
    same(catalogue.CASES[name](spark, DATA).toPandas(), duck.sql(catalogue.CASE_SQL[name]).df())


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


# ---------------------------------------------------------------- queries without SQL, by value

BY_VALUE = {"flagship_retrieve", "flagship_scores", "answer_questions", "clean_paged", "html_extract", "html_unhandled", "ann_topk", "ann_recall", "latent_vectors", "latent_recall", "clean_pages"}
#: On typed rows only: no table holds their markup.
TYPED = {"xml_opinions", "process_opinion", "chapter_html", "contents_table", "question_subset"}


def rows_of(spark, name):
    return (catalogue.CASES if name in catalogue.CASES else catalogue.QUERIES)[name](spark, DATA).collect()


def test_every_query_has_sql_or_values():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == BY_VALUE
    assert set(catalogue.CASES) - set(catalogue.QUERIES) == TYPED


def test_every_query_reads_a_table(spark, monkeypatch):
    """No registered query runs on typed rows alone."""
    from tessera.plans import fixtures

    seen = []
    monkeypatch.setattr(fixtures, "FIXTURES", {})
    for name in sorted(catalogue.CASES.keys() & catalogue.QUERIES.keys()):
        files = catalogue.QUERIES[name](spark, DATA).inputFiles()
        seen.append((name, bool(files)))
    assert all(there for _, there in seen), [n for n, there in seen if not there]


@pytest.fixture(scope="module")
def brute(spark, duck):
    """(question ids, chunk rows, cosine scores) by plain numpy."""
    chunks = duck.sql(catalogue.chunk_sql("documents")).df().sort_values(["doc_id", "chunk_index"]).reset_index(drop=True)
    items = duck.sql("select item_id, text from benchmark order by item_id").df()
    return items.item_id.tolist(), chunks, hashing(items.text.tolist()).astype(float) @ hashing(chunks.text.tolist()).astype(float).T


def test_flagship(spark, brute):
    ids, chunks, scores = brute
    texts = {(r.doc_id, r.chunk_index): r.text for r in chunks.itertuples()}
    got = {}
    for r in sorted(rows_of(spark, "flagship_retrieve"), key=lambda r: (r.qid, r.rank)):
        got.setdefault(r.qid, []).append(r)
    assert sorted(got) == ids
    at = {r.chunk_id: i for i, r in enumerate(chunks.itertuples())}
    for q, row in zip(ids, scores, strict=True):
        assert [r.rank for r in got[q]] == list(range(1, 9))
        assert np.allclose([r.score for r in got[q]], np.sort(row)[::-1][:8], atol=1e-6)
        for r in got[q]:
            c = chunks.iloc[at[r.chunk_id]]
            assert abs(row[at[r.chunk_id]] - r.score) < 1e-6
            assert r.window_text == "\n".join(texts[c.doc_id, i] for i in range(c.chunk_index - 1, c.chunk_index + 2) if (c.doc_id, i) in texts)


def test_place_id(spark):
    from pyspark.sql import functions as F

    from tessera.plans.flagship import place_id

    ids = lambda *rows: [r[0] for r in spark.createDataFrame(list(rows), "d long, c int").select(place_id(F.col("d"), F.col("c"))).collect()]
    assert ids((1, 2), (-1, 0), ((1 << 43) - 1, (1 << 20) - 1)) == [(1 << 20) + 2, -(1 << 20), (1 << 63) - 1]
    for row in ((1 << 43, 0), (0, 1 << 20)):
        with pytest.raises(Exception, match="no room"):
            ids(row)


def test_flagship_scores(spark, duck, brute):
    """The scores of the search itself, against the whole ranking by numpy."""
    ids, chunks, _ = brute
    items = dict(duck.sql("select item_id, text from benchmark").fetchall())
    held = collections.defaultdict(set)
    for q, d in duck.sql("select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)").fetchall():
        held[q].add(d)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    scores = np.round(unit(hashing([items[i] for i in ids]).astype(float)) @ unit(hashing(chunks.text.tolist()).astype(float)).T, 9)
    texts = {(r.doc_id, r.chunk_index): r.text for r in chunks.itertuples()}
    got = {r.qid: r for r in rows_of(spark, "flagship_scores")}
    assert sorted(got) == sorted(held)
    for q, r in got.items():
        order = np.lexsort((chunks.chunk_index, chunks.doc_id, -scores[ids.index(q)]))[:20]
        pool = [(chunks.doc_id[i], chunks.chunk_index[i]) for i in order]
        docs = [d for d, _ in pool]
        assert r.ranked == docs[:8] and r.expected == sorted(held[q])
        assert [r[f"recall_{k}"] for k in (1, 3, 5, 8, 10)] == [round(len(held[q] & set(docs[:k])) / len(held[q]), 6) for k in (1, 3, 5, 8, 10)]
        assert r.first_rank == next((i for i, d in enumerate(docs, 1) if d in held[q]), None)
        assert (r.hit, r.found) == (bool(held[q] & set(docs[:8])), sorted(held[q] & set(docs[:8])))
        assert r.off_target == [d for d in docs[:8] if d not in held[q]]
        assert r.anchors_in_chunk == any(items[q] in texts[c] for c in pool[:8])
        assert r.anchors_in_window == any(items[q] in texts.get((d, i + j), "") for d, i in pool[:8] for j in (-1, 0, 1))
        assert (r.anchors, r.missing_anchors) == (1, [] if r.anchors_in_window else [items[q]])
        assert r.crowding == max(collections.Counter(docs[:8]).values())


def test_answer_questions(spark, brute):
    ids, chunks, scores = brute
    got = {r.qid: r for r in rows_of(spark, "answer_questions")}
    assert sorted(got) == ids
    for q, row in zip(ids, scores, strict=True):
        r, best = got[q], np.flatnonzero(row >= row.max() - 1e-6)
        assert (r.degraded_category, r.unknown, r.malformed, r.cited, r.citations) == (None, [], [], ["S1"], 1)
        assert r.labels == [f"S{i}" for i in range(1, 9)]
        texts = [t for i in best for t in chunks[(chunks.doc_id == chunks.doc_id[i]) & (abs(chunks.chunk_index - chunks.chunk_index[i]) <= 1)].text]
        assert any(r.answer.removesuffix(" [S1]") in t for t in texts)


def test_clean_paged(spark):
    got = {r.source_id: r for r in rows_of(spark, "clean_paged")}
    p1 = got["p1"]
    assert (p1.pages, p1.pleading_paper, p1.footnotes, p1.running_heads) == (5, False, 2, ["#", "No. #-# Ebu v. USCIS Page #"])
    assert p1.lines[:3] == ["Body of page 1 ends with a hy-phen and goes on. last words more of it", "Body of page 2 ends with a hy-phen and goes on.", "[^ 1] First note text more of it"]
    assert got["p2"].pleading_paper
    assert got["p2"].lines == [" ".join(f"pleading line {i}" for i in range(1, 20))]
    assert got["p3"].lines == ["one page only with text"]
    assert (got["p4"].lines, got["p4"].pages) == ([], 2)


def test_clean_pages(spark):
    """Pages in rows of their own come out as their documents in one row each."""
    want = {r.source_id: r for r in catalogue.QUERIES["clean_paged"](spark, DATA).collect()}
    got = collections.defaultdict(list)
    for r in sorted(rows_of(spark, "clean_pages"), key=lambda r: r.page_no):
        got[r.source_id].append(r)
    assert {s: ([x for r in rs for x in r.lines], len(rs), sum(len(r.notes) for r in rs)) for s, rs in got.items()} == {s: (r.lines, r.pages, r.footnotes) for s, r in want.items()}


def test_html(spark, duck):
    got = {r.page_id: r for r in rows_of(spark, "html_extract")}
    pages = duck.sql("select page_id, html from pages").fetchall()
    assert sorted(got) == sorted(p for p, _ in pages)
    for page, html in pages:
        r, lines = got[page], got[page].lines
        assert r.error is None
        body = re.search(r"<article.*?</article>", html, re.S)
        # every list item of the article is a line of its own
        for item in re.findall(r"<li[^>]*>([^<]+)</li>", body[0] if body else ""):
            assert f"- {' '.join(item.split())}" in lines
        assert all(x == x.strip() and "  " not in x and "<p>" not in x for x in lines)
    counts = collections.Counter(t for r in got.values() for t in r.unhandled)
    assert {r.tag: r.pages for r in rows_of(spark, "html_unhandled")} == dict(counts)


def test_chapters(spark):
    got = {r.page_id: r for r in rows_of(spark, "chapter_html")}
    assert got[1].lines == ["## A title", "One bold, two", "open", "- a b", "- b", "Cap", "| h | 1 |", "[ALERT] Beware"]
    assert (got[1].unhandled, got[1].error) == (["video"], None)
    assert all((got[i].lines, got[i].error) == ([], "structure_changed") for i in (2, 3, 4))


def test_contents(spark):
    rows = rows_of(spark, "contents_table")
    assert [tuple(r)[:-1] for r in rows if r.page_id == 1] == [
        (1, "Volume 1", "Volume 1 - First", "Part A - Zero", "c1", "/c1"),
        (1, "Volume 1", "Volume 1 - First", "Part A - Zero", "c2", "/c2"),
        (1, "Volume 12", "Volume 12 - Last", "Part D - Two", "c4", "/c4"),
    ]
    assert [r.volume for r in rows if r.page_id == 2 and r.error and r.chapter_title is None] == ["Volume 1", "Volume 12"]


def test_xml_opinions(spark):
    got = {r.source_id: r for r in rows_of(spark, "xml_opinions")}
    assert got["o1"].body == ["X, J.", "Castracani held\ue0001\ue001 so far.", "> quoted"]
    assert (got["o1"].notes, got["o1"].unhandled, got["o1"].error) == ({1: "1. A note."}, {"table": 1}, None)
    assert (got["o2"].error, got["o3"].error) == ("bad_xml", "structure_changed")


def test_process_opinion(spark):
    got = {r.source_id: r for r in rows_of(spark, "process_opinion")}
    x1 = got["x1"]
    assert x1.text == "X, J.\nHeld [2] so, and more.\n[^ 2] 2. Kept note.\n[^ 5] 5. Nobody points here."
    assert (x1.orphan_marks, x1.unplaced_footnotes, x1.footnotes_kept, x1.footnotes_dropped, x1.lines, x1.error) == ([7], [5], 2, 0, 4, None)
    assert (got["x2"].text, got["x2"].lines, got["x2"].footnotes_kept) == ("One page only with te-xt", 1, 0)
    assert {k: r.error for k, r in got.items() if r.text is None} == {"x3": "no_content", "x4": "bad_xml", "x5": "structure_changed", "x6": "no_content"}


def test_approximate_search(spark, duck):
    """Scores are exact cosines, in order; at least nine tenths of the true neighbours are among them."""
    e = duck.sql("select vec_id, embedding from embeddings order by vec_id").df()
    v = np.stack(e.embedding).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    at = {i: k for k, i in enumerate(e.vec_id)}
    got = collections.defaultdict(list)
    for r in sorted(rows_of(spark, "ann_topk"), key=lambda r: (r.qid, r.rank)):
        assert abs(v[at[r.qid]] @ v[at[r.vec_id]] - r.score) < 1e-8
        got[r.qid].append(r)
    assert sorted(got) == [i for i in e.vec_id if i % 50 == 0]
    inside = 0
    for q, hits in got.items():
        assert [r.rank for r in hits] == list(range(1, 9)) and [r.score for r in hits] == sorted((r.score for r in hits), reverse=True)
        inside += len({r.vec_id for r in hits} & set(e.vec_id.to_numpy()[np.lexsort((e.vec_id, -np.round(v @ v[at[q]], 9)))[:8]]))
    r = rows_of(spark, "ann_recall")[0]
    assert (r.queries, r.neighbours, r.rows) == (len(got), 8 * len(got), len(e))
    assert r.recall == round(inside / (8 * len(got)), 6) >= 0.9
    assert r.probes <= r.cells_read <= r.cells


def test_latent(spark, duck):
    """The learned encoder's leading space is numpy's; recall is counted as by hand."""
    from tessera.operators import latent

    docs = duck.sql("select doc_id, text from documents order by doc_id").df()
    model = latent.fit(spark.read.parquet(f"{DATA}/documents.parquet"), catalogue_scale.DIM)
    a = np.zeros((len(docs), len(model.idf)))
    for row, t in zip(a, docs.text, strict=True):
        at, n = latent.counts(t)
        row[at] = latent.weighted(at, n, model.idf)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(model.values, s[: catalogue_scale.DIM], rtol=0.03)
    # the whole space holds as much of the matrix as numpy's best does
    assert np.square(a @ model.vectors).sum() > 0.99 * np.square(s[: catalogue_scale.DIM]).sum()
    got = {r.doc_id: np.array(r.embedding) for r in rows_of(spark, "latent_vectors")}
    want = latent.encode(model)(docs.text.tolist())
    assert all(np.allclose(got[i], w, atol=1e-4) for i, w in zip(docs.doc_id, want, strict=True))
    rows = {r.encoder: r for r in rows_of(spark, "latent_recall")}
    items = duck.sql("select item_id, text from benchmark order by item_id").df()
    held = duck.sql("select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)").fetchall()
    for name, run in (("hashing", hashing), ("latent", latent.encode(model))):
        scores = np.round(run(items.text.tolist()).astype(float) @ run(docs.text.tolist()).astype(float).T, 6)
        least = {q: np.sort(row)[::-1][19] for q, row in zip(items.item_id, scores, strict=True)}
        at = {d: i for i, d in enumerate(docs.doc_id)}
        sure = sum(scores[list(items.item_id).index(q), at[d]] > least[q] for q, d in held)
        tied = sum(scores[list(items.item_id).index(q), at[d]] >= least[q] - 1e-6 for q, d in held)
        assert rows[name].expected == len(held) and sure <= rows[name].found <= tied


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
