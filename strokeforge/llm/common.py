"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard_table, exists, materialize, scratch, stored

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys that hold over 1/HOT_SHARE of all rows are hot, so there are at most HOT_SHARE of them.
HOT_SHARE = 1000
HOT_LEAST = 10_000
#: Bytes of text that a Python worker looks at together.
SLICE = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Join left with right, which has one row for each key and in column n the key's rows in left.

    The hot keys, at most HOT_SHARE of them by construction, are broadcast; the others are
    shuffled. Only inner and left joins. Keys must not be null; right is looked at once more, so
    it should be stored.
    """
    least = max(HOT_LEAST, total // HOT_SHARE)
    payload = [c for c in right.columns if c not in keys]
    hot = right.filter(F.col(n) > least).select(*keys, F.struct(*payload).alias("_hot"))
    if hot.isEmpty():
        return left.join(right.hint("shuffle_hash"), keys, how).select(*left.columns, *payload)
    rest = right.filter(F.col(n) <= least).hint("shuffle_hash")
    marked = left.join(F.broadcast(hot), keys, "left")
    one = marked.filter(F.col("_hot").isNotNull()).select(*left.columns, *[F.col(f"_hot.{c}").alias(c) for c in payload])
    two = marked.filter(F.col("_hot").isNull()).drop("_hot").join(rest, keys, how).select(*left.columns, *payload)
    return one.unionByName(two)


def few(rows: int) -> int:
    """In how many files at most to store a table of so many rows of some numbers."""
    return max(8, -(-rows // 200_000))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most about most bytes of a column of strings or binaries, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        done = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on and would hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


__all__ = ["HOT_LEAST", "HOT_SHARE", "SLICE", "WORD", "discard_table", "documents", "exists", "few", "give_back", "hot_join", "materialize", "scratch", "slices", "stored", "text_or_empty"]
