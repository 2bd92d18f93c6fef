"""SVG documents as files named by their documents: a data source that reads, writes and streams.

read_files() gives path, name and svg of a folder of any number of files: a task lists it, the names
are a table, and the driver holds none of them. spark.read.format("svg_files").load(folder) gives the
same of a folder whose paths the driver can hold. A task reads as many whole files as fit into
partitionBytes. df.write.format("svg_files").mode("append").save(folder) takes
name and svg and makes one file a document, named by it. A file is written beside its place and
moved there, so a reader sees whole files only, and a task that runs again after a lost executor
leaves the same files. The folder is any that pyarrow can open (a path, file:, hdfs:, s3:).

Defined results: a null name, or one with a slash or of more than 200 bytes, is refused, as is a null
drawing. Of equal names the file written last stays; write_files() refuses them before it writes.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import EngineError
from . import shared

SUFFIX = ".svg"
PARTITION_BYTES = 16 << 20
#: What opening a file counts as, in bytes: many small files are few tasks, but not one.
OPEN_COST = 64 << 10
LONGEST_NAME = 200
#: Files that one task writes: more documents are more tasks, not longer ones.
FILES = 8192
#: Tasks that read, from which on a task takes several parts of PARTITION_BYTES, and how many at most.
TASKS, PARTS = 2048, 32
#: Rows of a batch of names, and rows and bytes of a batch of drawings.
NAMES, DRAWINGS, BATCH_BYTES = 10_000, 1000, 4 << 20


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def _root(folder: str) -> str:
    return _open(folder)[1].rstrip("/")


def _entries(folder: str) -> Iterator[tuple[str, int]]:
    """File name and bytes of each drawing of a folder, unordered; those of a local folder come as it is read, of other stores as one list."""
    from pyarrow import fs

    store, root = _open(folder)
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(root) as found:
            for f in found:
                if f.name.endswith(SUFFIX) and f.is_file():
                    yield f.name, f.stat().st_size
    else:
        for f in store.get_file_info(fs.FileSelector(root)):
            if f.type == fs.FileType.File and f.base_name.endswith(SUFFIX):
                yield f.base_name, f.size


def _text(store, path: str) -> str:
    with store.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace")


def _numbering(most: int) -> Callable[[int], int]:
    """What gives files, by their bytes and in their order, the number of the part that they are read in."""
    part = held = 0

    def number(size: int) -> int:
        nonlocal part, held
        cost = size + OPEN_COST
        if held and held + cost > most:
            part, held = part + 1, 0
        held += cost
        return part

    return number


class Files(InputPartition):
    """Paths that one task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class SvgReader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> list[Files]:
        root, number, out = _root(self.folder), _numbering(self.most), [[]]
        for name, size in sorted(_entries(self.folder)):
            if number(size) == len(out):
                out.append([])
            out[-1].append(f"{root}/{name}")
        return [Files(paths) for paths in out]

    def read(self, partition: Files) -> Iterator[tuple[str, str, str]]:
        store, _ = _open(self.folder)
        for path in partition.paths:
            yield path, path.rpartition("/")[2][: -len(SUFFIX)], _text(store, path)


class Written(WriterCommitMessage):
    """How much a task wrote: two numbers, whatever the number of files."""

    def __init__(self, files: int, size: int):
        self.files, self.size = files, size


class SvgWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder
        store, root = _open(folder)
        store.create_dir(root, recursive=True)

    def write(self, rows: Iterator) -> Written:
        store, root = _open(self.folder)
        files = size = 0
        for row in rows:
            name, svg = row["name"], row["svg"]
            if not name or svg is None or "/" in name or name.startswith(".") or len(name.encode()) > LONGEST_NAME:
                raise ValueError(f"no file can be named {name!r}" if svg is not None else f"{name!r} has no drawing")
            data, at = svg.encode(), f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(at) as f:
                f.write(data)
            store.move(at, f"{root}/{name}{SUFFIX}")
            files, size = files + 1, size + len(data)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.folder)
        with store.open_output_stream(f"{root}/_SUCCESS") as f:
            f.write(f"{sum(m.files for m in messages if m)} {sum(m.size for m in messages if m)}\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Whole files stay: a second run writes the same over them."""


class SvgStreamWriter(SvgWriter, DataSourceStreamWriter):
    """A batch that runs again writes the same files, so each document is there once."""

    def commit(self, messages: list[Written | None], batch: int) -> None:  # noqa: ARG002
        SvgWriter.commit(self, messages)

    def abort(self, messages: list[Written | None], batch: int) -> None:
        """As above."""


class SvgFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "svg_files"

    def schema(self) -> str:
        return "path string, name string, svg string"

    def reader(self, schema) -> SvgReader:  # noqa: ARG002
        return SvgReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> SvgWriter:  # noqa: ARG002
        if overwrite:
            raise ValueError("files are added or replaced by name: use mode append")
        return SvgWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> SvgStreamWriter:  # noqa: ARG002, N802
        return SvgStreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SvgFiles)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """File name and bytes of the drawings of a folder, which one task lists."""

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _entries(folder)
        while rows := list(itertools.islice(found, NAMES)):
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.int64())], names=["name", "size"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "name string, size long")


def read_files(spark: SparkSession, folder: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """path, name and svg of the files of a folder, in the order of their paths.

    The folder is listed when this is called, and its names are stored as a table that is dealt to the tasks that read.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbering(partition_bytes)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([number(size) for size in batch.column(1).to_pylist()], pa.int64())], names=["name", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)[0], _root(folder)
        rows, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                svg = _text(store, path := f"{root}/{name}")
                rows.append((path, name[: -len(SUFFIX)], svg))
                held += len(svg)
                if len(rows) == DRAWINGS or held > BATCH_BYTES:
                    yield _drawings(rows)
                    rows, held = [], 0
        if rows:
            yield _drawings(rows)

    names = shared.materialize(list_files(spark, folder).sortWithinPartitions("name").mapInArrow(numbered, "name string, part long"), "listing")
    parts = (names.agg(F.max("part")).first()[0] or 0) + 1
    each = min(1 + parts // TASKS, PARTS)
    dealt = names.repartitionById(-(-parts // each), F.expr(f"cast(part div {each} AS INT)")).select("name").sortWithinPartitions("name")
    return dealt.mapInArrow(read, "path string, name string, svg string")


def _drawings(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "name", "svg"])


def dealt(df: DataFrame, n: int) -> DataFrame:
    """df, of n rows, in parts of about FILES rows, if it has fewer parts than that takes."""
    parts = -(-n // FILES)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


def write_files(df: DataFrame, folder: str, key: str) -> None:
    """A file for each row of df, named by its key; equal keys are refused before anything is written."""
    register(df.sparkSession)
    named = df.select(F.col(key).cast("string").alias("name"), "svg")
    names = named.groupBy("name").count().agg(F.sum("count").alias("n"), F.min(F.when(F.col("count") > 1, F.struct("name"))).alias("twice")).first()
    if names["twice"]:
        raise EngineError("INVALID_REQUEST", f"several documents are named {names['twice']['name']!r}")
    dealt(named, names["n"] or 0).write.format("svg_files").mode("append").save(folder)


def stream_files(df: DataFrame, folder: str, key: str, checkpoint: str):
    """As write_files(), of a stream, until what is there is written; of equal keys the last one stays.

    The source's own bounds (maxFilesPerTrigger, maxBytesPerTrigger) say how much a batch, and so a task, writes.
    """
    register(df.sparkSession)
    named = df.select(F.col(key).cast("string").alias("name"), "svg")
    return named.writeStream.format("svg_files").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
