"""Tables that are used more than once: kept on the executors' disks, or written to the folder that all share.

materialize() cuts lineage for good: for loops, and for tables whose rows must not change when
they are made again (numbers given by place). stored() does not: what is lost with an executor is
made again from where it came, so what it came from must stay. A stored table's plan is a part of the
plans over it, so tables made from stored ones are materialized.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that this driver wrote and has not deleted, and tables that it keeps on executors' disks.
_written: list[str] = []
_stored: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is named and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strokeforge-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, label: str, parts: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage for good.

    parts: in so many files at most, for a table that is known to be small.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def stored(df: DataFrame) -> DataFrame:
    """df, kept on the disks of the executors from its first use on."""
    _stored.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole."""
    fs, at = _file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)
    if path in _written:
        _written.remove(path)


def discard_table(df: DataFrame) -> None:
    """Delete a table of materialize(), once nothing reads it any more."""
    discard(df.sparkSession, df._scratch)


def release(spark: SparkSession) -> int:
    """Delete every table that this driver's operators wrote or keep, once their results are stored; how many."""
    n = len(_written) + len(_stored)
    while _stored:
        _stored.pop().unpersist()
    for path in list(_written):
        discard(spark, path)
    return n
