"""An index as a transactional data source: ``df.write.format("tessera_index")`` and ``spark.read.format("tessera_index")``.

Two phases. Every task writes a file of its own under ``data/<job>``, named by partition and
attempt, and tells the driver its name, rows and columns' bounds. When all tasks are done the
driver writes a manifest that lists exactly the files of the attempts that Spark counts, and
only then replaces the pointer ``CURRENT`` by a rename. A reader takes the pointer, then the
manifest, then its files: it sees one whole version, whatever else lies in the folder. What a
failed job, a failed attempt or a second attempt of a task has left behind is in no manifest;
an aborted job deletes its folder, :func:`vacuum` deletes all that the manifest in force
doesn't name.

``overwrite`` makes a version of the new files, ``append`` one of the old and the new. A job
that finds another version in force than when it began raises and changes nothing. Comparisons
of a column with a number or string skip files whose bounds exclude them.

Files are Parquet, read and written through pyarrow's file systems: paths of local and shared
mounts, hdfs and object stores. The folder must be shared on a cluster.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "tessera_index"
_POINTER = "CURRENT"


class ChangedIndex(RuntimeError):
    """Another job has published a version since this one began."""


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder in it, in tasks as on the driver."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    system, root = fs.FileSystem.from_uri(path)
    return system, root.rstrip("/")


def _read(system: fs.FileSystem, path: str) -> bytes | None:
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as f:
        return f.read()


def _replace(system: fs.FileSystem, path: str, content: bytes) -> None:
    """Readers see the old content or the new, never a part."""
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(content)
    system.move(part, path)


def current(path: str) -> dict | None:
    """The manifest in force: version, schema, files (name, rows, bounds); None before the first commit."""
    system, root = filesystem(path)
    version = _read(system, f"{root}/{_POINTER}")
    return None if version is None else json.loads(_read(system, f"{root}/manifests/{version.decode()}.json"))


def vacuum(path: str) -> int:
    """Delete data files and manifests that the version in force doesn't need; the number of files deleted. No job may be writing."""
    system, root = filesystem(path)
    manifest = current(path)
    keep = {f["name"] for f in manifest["files"]} if manifest else set()
    gone = 0
    for info in system.get_file_info(fs.FileSelector(f"{root}/data", recursive=True, allow_not_found=True)):
        if info.type == fs.FileType.File and info.path[len(root) + 1 :] not in keep:
            system.delete_file(info.path)
            gone += 1
    for info in system.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True)):
        if not manifest or info.base_name != f"{manifest['version']}.json":
            system.delete_file(info.path)
            gone += 1
    return gone


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    bounds: dict = field(default_factory=dict)


def _bounds(known: dict, batch: pa.RecordBatch) -> None:
    """Widen the bounds of the columns of whole numbers and strings by a batch; NaN-able and nested ones have none."""
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if pa.types.is_integer(column.type) or pa.types.is_string(column.type):
            ends = pc.min_max(column).as_py()
            if ends["min"] is not None:
                low, high = known.get(name, (ends["min"], ends["max"]))
                known[name] = (min(low, ends["min"]), max(high, ends["max"]))


class IndexWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.job = f"{time.time_ns()}-{uuid.uuid4().hex}"
        manifest = current(path)
        self.base = manifest["version"] if manifest else None
        if manifest and not overwrite and json.loads(schema.json()) != json.loads(manifest["schema"]):
            raise ValueError("append: columns differ from those of the index")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = filesystem(self.path)
        task = TaskContext.get()
        name = f"data/{self.job}/part-{task.partitionId():06d}-{task.taskAttemptId()}.parquet"
        out, rows, bounds = None, 0, {}
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(f"{root}/data/{self.job}")
                    out = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=system)
                out.write_batch(batch)
                rows += batch.num_rows
                _bounds(bounds, batch)
        finally:
            if out is not None:
                out.close()
        return Written(name, rows, bounds)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = filesystem(self.path)
        manifest = current(self.path)
        if (manifest["version"] if manifest else None) != self.base:
            self.abort(messages)
            raise ChangedIndex(f"{self.path}: another version was published meanwhile")
        files = [] if self.overwrite or not manifest else manifest["files"]
        files = files + [{"name": m.name, "rows": m.rows, "bounds": m.bounds} for m in messages if m is not None and m.rows]
        system.create_dir(f"{root}/manifests")
        _replace(system, f"{root}/manifests/{self.job}.json", json.dumps({"version": self.job, "schema": self.schema.json(), "files": files}).encode())
        _replace(system, f"{root}/{_POINTER}", self.job.encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = filesystem(self.path)
        if system.get_file_info(f"{root}/data/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/data/{self.job}")


def _may_hold(bounds: dict, f: Filter) -> bool:
    low, high = bounds[f.attribute[0]]
    try:
        if isinstance(f, EqualTo):
            return low <= f.value <= high
        if isinstance(f, In):
            return any(low <= v <= high for v in f.value if v is not None)
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            return high > f.value or (high == f.value and isinstance(f, GreaterThanOrEqual))
        if isinstance(f, (LessThan, LessThanOrEqual)):
            return low < f.value or (low == f.value and isinstance(f, LessThanOrEqual))
    except TypeError:
        pass
    return True


class IndexReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema
        manifest = current(path)
        if manifest is None:
            raise FileNotFoundError(f"{path}: no version of an index")
        self.files = manifest["files"]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Files are skipped by their bounds; Spark still applies every filter to the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1:
                self.files = [x for x in self.files if f.attribute[0] not in x["bounds"] or _may_hold(x["bounds"], f)]
            yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f["name"]) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        system, root = filesystem(self.path)
        schema = to_arrow_schema(self.schema)
        with system.open_input_file(f"{root}/{partition.value}") as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=4_096, columns=schema.names):
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, schema.types, strict=True)], schema=schema)


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        manifest = current(self.options["path"])
        if manifest is None:
            raise FileNotFoundError(f"{self.options['path']}: no version of an index")
        return T.StructType.fromJson(json.loads(manifest["schema"]))

    def reader(self, schema: T.StructType) -> IndexReader:
        return IndexReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> IndexWriter:
        return IndexWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to ``spark``; lets Spark hand it filters, which it skips files by."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexSource)
