"""Readers, sinks and streaming on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation
from tessera.operators import ingest as ingest_policies
from tessera.sources import readers, sinks
from tessera.streaming import ingest


def test_documents_and_sidecars(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    (tmp_path / "b.txt").write_text("alone")
    (tmp_path / "a_metadata.json").write_text(json.dumps({"source_id": "a", "source_type": "uscis", "title": "T", "citation": None, "url": "u"}))
    got = {r.source_id: r for r in readers.documents(spark, str(tmp_path)).collect()}
    assert (got["a"].text, got["a"].title, got["a"].missing) == ("one\n\ntwo", "T", False)
    assert got["b"].missing
    sinks.write_documents(readers.documents(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_opinions_and_manifest(spark, tmp_path):
    (tmp_path / "opinion_1.json").write_text(json.dumps({"id": 1, "plain_text": "x", "absolute_url": "/o/1"}))
    (tmp_path / "search_1.json").write_text("{}")
    (tmp_path / "m.json").write_text(json.dumps({"selected": [{"opinion_id": 1, "case_name": "A v. B", "court_id": "ca2", "barrier": ["delay", "character"], "why": "w", "date_filed": "2001-02-03"}]}))
    payloads = readers.opinions(spark, str(tmp_path))
    assert [r.id for r in payloads.collect()] == [1]
    side = readers.opinion_sidecar(payloads, readers.manifest(spark, str(tmp_path / "m.json")), "https://c").first()
    assert (side.source_id, side.barrier, side.url, side.title) == ("opinion_1", "delay,character", "https://c/o/1", "A v. B")


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "q1", "question": "?", "expected": [{"source_id": "s", "anchors": ["a"]}]}, {"id": "q2", "question": "!"}]}))
    rows = readers.questions(spark, str(tmp_path / "q.json")).orderBy("position").collect()
    assert [r.id for r in rows] == ["q1", "q2"]
    assert rows[0].expected[0].anchors == ["a"]
    assert rows[1].acceptable is None


def test_rebuild_replaces(spark, tmp_path):
    path = str(tmp_path / "index")
    sinks.rebuild_index(spark.range(10).toDF("chunk"), path)
    sinks.rebuild_index(spark.range(3).toDF("chunk"), path)
    assert sinks.current_index(spark, path).count() == 3
    broken = spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("chunk"))
    with pytest.raises(Exception, match="no"):
        sinks.rebuild_index(broken, path)
    assert sinks.current_index(spark, path).count() == 3


def test_first_folder_wins(spark, tmp_path):
    for folder, files in (("x", {"a": "one", "b": "two"}), ("y", {"b": "other", "c": "\n"})):
        (tmp_path / folder).mkdir()
        for stem, text in files.items():
            (tmp_path / folder / f"{stem}.txt").write_text(text)
    got = {r.source_id: r.text for r in readers.first_texts(spark, str(tmp_path / "x"), str(tmp_path / "y")).collect()}
    assert got == {"a": "one", "b": "two", "c": ""}


def test_run_files(spark, tmp_path):
    q = [{"id": "q1", "answer": "x", "citations": 2, "unknown": ["S9"]}, {"id": "p", "probe": True, "answer": None, "citations": None, "malformed": ["m"]}]
    for name, k in (("b.json", 8), ("a.json", 8), ("c.json", 5)):
        (tmp_path / name).write_text(json.dumps({"config": {"k": k, "thinking": "low", "model": name}, "totals": {"answered": 1.0}, "questions": q}))
    runs = readers.run_files(spark, str(tmp_path))
    assert evaluation.grid_totals(runs).first().asDict() == {"answers": 3, "citations": 6, "fabricated": 3, "malformed": 3}
    assert evaluation.shipping_run(runs, 8, "low").first().file == "a.json"
    assert evaluation.shipping_run(runs, 9, "low").count() == 0
    assert evaluation.grid_totals(runs.filter("false")).first().answers == 0


def test_landed_attempts(spark, tmp_path):
    rows = [{"url": "a", "attempt": 1, "status": 503, "retry_after": "7"}, {"url": "a", "attempt": 2, "status": 200, "body": "<p>x"}, {"url": "b", "attempt": 1, "status": 429, "retry_after": "30"}, {"url": "c", "attempt": 1, "error": "timeout"}]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    got = {r.url: (r.attempts, r.body, r.category, r.wait) for r in ingest_policies.fetched(readers.landed(spark, str(tmp_path))).collect()}
    assert got == {"a": (2, "<p>x", None, None), "b": (1, None, "rate_limited", 30), "c": (1, None, "timeout", None)}


def test_raw_and_results(spark, tmp_path):
    sinks.write_raw(spark.createDataFrame([("x", "{}"), ("y", "[1]")], "stem string, body string"), str(tmp_path / "raw"))
    assert {(r.stem, r.value) for r in spark.read.text(str(tmp_path / "raw")).collect()} == {("x", "{}"), ("y", "[1]")}
    folder = sinks.write_results(spark.range(2), str(tmp_path / "out"), {"k": 8, "model": "m/1"})
    assert folder.endswith("k8-modelm_1")
    assert spark.read.json(folder).count() == 2


def test_chapter_sidecar(spark):
    df = spark.createDataFrame([("s", "V", "P", "C", "/u", "2024-01-01")], "stem string, volume_title string, part_title string, chapter_title string, chapter_url string, scraped_date string")
    r = readers.chapter_sidecar(df).first()
    assert (r.source_id, r.source_type, r.title, r.url, r.retrieved, r.barrier) == ("s", "uscis", "V / P / C", "/u", "2024-01-01", None)


def test_gate(spark):
    df = spark.createDataFrame([(["S9"],), ([],)], "unknown array<string>")
    assert sinks.fabricated(df) == 1
    assert sinks.fabricated(df.filter(F.size("unknown") == 0)) == 0


@pytest.mark.parametrize("again", [1, 2])
def test_streaming_ingest(spark, tmp_path, again):
    docs = spark.createDataFrame([(1, "a\nb", "en", "s", 3), (2, "c", "en", "s", 1)], ingest.DOCUMENT)
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(again):
        ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
