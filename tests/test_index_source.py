"""The transactional index source: one whole version for readers, whatever fails."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.session import shared_dir
from tessera.sources import index_source as ix


@pytest.fixture(scope="module")
def source(spark):
    ix.register(spark)
    return spark


def rows(spark, n, start=0):
    return spark.range(start, start + n).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("té "), F.col("id").cast("string"))).alias("text"), F.array(F.col("id").cast("int"), F.lit(None)).alias("tags"), (F.col("id") / 3).alias("score"), F.struct(F.col("id").alias("x")).alias("s")).repartitionByRange(5, "id")


def save(df, path, mode="overwrite"):
    df.write.format(ix.NAME).mode(mode).save(path)


def load(spark, path):
    return spark.read.format(ix.NAME).load(path)


def files(path):
    return sorted(f for _, _, names in os.walk(f"{path}/data") for f in names)


def test_round_trip_and_versions(source):
    path = shared_dir(source)
    with pytest.raises(Exception, match="no version"):
        load(source, path)
    save(rows(source, 100), path)
    assert sorted(load(source, path).collect()) == sorted(rows(source, 100).collect())
    assert load(source, path).schema == rows(source, 1).schema
    save(rows(source, 50, 100), path, "append")
    assert sorted(r.id for r in load(source, path).collect()) == list(range(150))
    with pytest.raises(Exception, match="columns differ"):
        save(source.range(3), path, "append")
    save(source.range(3), path)
    assert sorted(r.id for r in load(source, path).collect()) == [0, 1, 2]
    held = len(files(path))
    assert ix.vacuum(path) > 0 and len(files(path)) < held
    assert sorted(r.id for r in load(source, path).collect()) == [0, 1, 2]


def test_failed_tasks_leave_nothing_visible(source):
    path = shared_dir(source)
    save(rows(source, 100), path)
    before = files(path)

    @F.udf("long")
    def lost(i):
        if i == 999:
            raise ValueError("executor lost")
        return i

    for mode in ("overwrite", "append"):
        with pytest.raises(PySparkException):
            save(rows(source, 1000).withColumn("id", lost("id")), path, mode)
        assert sorted(r.id for r in load(source, path).collect()) == list(range(100))
    assert set(before) <= set(files(path))
    ix.vacuum(path)
    assert files(path) == before


def test_second_attempts_and_late_jobs(source, monkeypatch):
    """Of two attempts of a task the one that Spark counts is read; a job that another one has overtaken changes nothing."""
    path = shared_dir(source)
    schema = source.range(1).schema
    batches = [source.range(5).toArrow().combine_chunks().to_batches()[0]]

    class Task:
        attempt = 0

        @staticmethod
        def get():
            Task.attempt += 1
            return Task

        partitionId = staticmethod(lambda: 0)
        taskAttemptId = staticmethod(lambda: Task.attempt)

    monkeypatch.setattr(ix, "TaskContext", Task)
    first, late = ix.IndexWriter(path, schema, True), ix.IndexWriter(path, schema, False)
    lost, counted = first.write(iter(batches)), first.write(iter(batches))
    waiting = late.write(iter(batches))
    assert ix.current(path) is None
    first.commit([counted, None])
    assert len(files(path)) == 3 and lost.name != counted.name
    assert [f["name"] for f in ix.current(path)["files"]] == [counted.name]
    with pytest.raises(ix.ChangedIndex):
        late.commit([waiting])
    assert sorted(r.id for r in load(source, path).collect()) == [0, 1, 2, 3, 4]

    def broken(*_):
        raise OSError("full")

    third = ix.IndexWriter(path, schema, True)
    done = third.write(iter(batches * 2))
    monkeypatch.setattr(ix, "_replace", broken)  # the driver dies before the pointer moves
    with pytest.raises(OSError, match="full"):
        third.commit([done])
    assert sorted(r.id for r in load(source, path).collect()) == [0, 1, 2, 3, 4]


def test_files_are_skipped_by_their_bounds(source):
    path = shared_dir(source)
    save(rows(source, 1000), path)
    every = {f["name"]: f for f in ix.current(path)["files"]}
    assert len(every) == 5 and sum(f["rows"] for f in every.values()) == 1000
    for where, most in (("id = 7", 1), ("id in (3, 998)", 2), ("id > 997", 1), ("id >= 0", 5), ("id < 0", 0), ("text = 'té 77'", 5), ("id <= 1 and id > 1", 1)):
        df = load(source, path).filter(where)
        assert sorted(r.id for r in df.collect()) == sorted(r.id for r in rows(source, 1000).filter(where).collect())
        reader = ix.IndexReader(path, rows(source, 1).schema)
        filters = {"id = 7": [ix.EqualTo(("id",), 7)], "id in (3, 998)": [ix.In(("id",), (3, 998))], "id > 997": [ix.GreaterThan(("id",), 997)], "id < 0": [ix.LessThan(("id",), 0)]}.get(where, [])
        assert list(reader.pushFilters(filters)) == filters and len(reader.partitions()) <= most if filters else True


def test_empty(source):
    path = shared_dir(source)
    save(source.range(0), path)
    assert load(source, path).collect() == [] and load(source, path).columns == ["id"]
