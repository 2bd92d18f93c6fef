"""The adaptive grid: complexity by cell, the nodes that split, and the leaf of a point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids

SIDE = 2**ids.LEVEL
SPLIT = 0.5
#: Keys whose nodes are summed at a time.
SLICE = 256


def covered(segments: DataFrame, canvas: float = ids.CANVAS) -> DataFrame:
    """segments with the columns a to b and rows e to f of cells that their boxes cover; those off the canvas are left out."""
    cut = lambda v: f"cast(trunc_({v} / {canvas!r}D * {SIDE}) AS INT)".replace("trunc_", "")
    lo = lambda v: f"greatest(0, {cut(v)})"
    hi = lambda v: f"least({SIDE - 1}, {cut(v)})"
    return segments.withColumns({"a": F.expr(lo("x0")), "b": F.expr(hi("x1")), "e": F.expr(lo("y0")), "f": F.expr(hi("y1"))}).filter("a <= b AND e <= f")


def complexity(segments: DataFrame, key: str, canvas: float = ids.CANVAS) -> DataFrame:
    """key, gx, gy, c: the weight of each cell that the box of a segment (x0, y0, x1, y1, c) covers."""
    rows = covered(segments, canvas)
    cells = rows.withColumn("gx", F.explode(F.sequence("a", "b"))).withColumn("gy", F.explode(F.sequence("e", "f")))
    return cells.groupBy(key, "gx", "gy").agg(F.sum("c").alias("c"))


def _heavy(boxes: pa.ListArray, threshold: float) -> pa.ListArray:
    """The codes of the nodes beyond the threshold of each row's boxes (a, b, e, f, c)."""
    n = len(boxes)
    owner = np.repeat(np.arange(n), pc.list_value_length(boxes).to_numpy(zero_copy_only=False))
    a, b, e, f, c = (boxes.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(5))
    rows, codes = [], []
    for level in range(ids.LEVEL):
        side, size = 2**level, SIDE >> level
        # A node has the cells from n * size to (n + 1) * size: the last are the first of the next node.
        left, top = np.maximum(-(-a // size) - 1, 0), np.maximum(-(-e // size) - 1, 0)
        wide = b // size - left + 1
        count = wide * (f // size - top + 1)
        k = np.repeat(np.arange(len(a)), count)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
        nx, ny = left[k] + nth % wide[k], top[k] + nth // wide[k]
        cells = (np.minimum(b[k], (nx + 1) * size) - np.maximum(a[k], nx * size) + 1) * (np.minimum(f[k], (ny + 1) * size) - np.maximum(e[k], ny * size) + 1)
        total = np.bincount((owner[k] * side + ny) * side + nx, cells * c[k], n * side * side).reshape(n, -1)
        row, at = np.nonzero((total > threshold) | np.isnan(total))
        rows.append(row)
        codes.append(level * SIDE * SIDE + at // side * SIDE + at % side)
    row = np.concatenate(rows)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(codes)[np.argsort(row, kind="stable")], pa.int32()))


def nodes(weights: DataFrame, key: str, threshold: float = SPLIT, canvas: float = ids.CANVAS) -> DataFrame:
    """key, nodes: what splits(complexity(weights)) gives, from the boxes of segments (x0, y0, x1, y1, c) instead of cells.

    The segments of a key, a drawing's, are collected, and a segment adds its weight to a node as often as
    its box has cells of the node's. So tasks hold segments and the nodes of SLICE keys, not all cells of all keys.
    """
    boxes = covered(weights, canvas).filter("c IS NOT NULL").groupBy(key).agg(F.collect_list(F.struct("a", "b", "e", "f", "c")).alias("_boxes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), _heavy(part.column(1), threshold)], names=[key, "nodes"])

    return boxes.mapInArrow(run, f"`{key}` {weights.schema[key].dataType.simpleString()}, nodes array<int>").filter("size(nodes) > 0")


def splits(grid: DataFrame, key: str, threshold: float = SPLIT) -> DataFrame:
    """key, nodes: codes (level, ny, nx) of the nodes above the deepest level whose weight is beyond the threshold.

    A node also sums the first row and column after it, so a cell on an edge counts for both sides.
    """
    def over(g: str, size: str) -> str:
        return f"IF({g} % {size} = 0 AND {g} > 0, array(cast(floor({g} / {size}) AS INT), cast(floor({g} / {size}) AS INT) - 1), array(cast(floor({g} / {size}) AS INT)))"

    rows = grid.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(ids.LEVEL - 1)))).withColumn("size", F.expr(f"cast({SIDE} / power(2, level) AS INT)"))
    rows = rows.withColumn("nx", F.explode(F.expr(over("gx", "size")))).withColumn("ny", F.explode(F.expr(over("gy", "size"))))
    heavy = rows.groupBy(key, "level", "nx", "ny").agg(F.sum("c").alias("c")).filter(F.col("c") > threshold)
    return heavy.groupBy(key).agg(F.collect_set(F.expr(f"level * {SIDE * SIDE} + ny * {SIDE} + nx").cast("int")).alias("nodes"))


def leaf_level(x: str, y: str, nodes: str = "nodes", least: int = 0, canvas: float = ids.CANVAS) -> str:
    """SQL: level of the leaf of a point: down from the root while the node splits."""
    at = lambda v: f"cast(floor({ids.clamped(v, canvas)} / ({canvas!r}D / power(2D, l))) AS INT)"
    goes = f"l < {least} OR array_contains({nodes}, cast(l * {SIDE * SIDE} + {at(y)} * {SIDE} + {at(x)} AS INT))"
    return f"aggregate(sequence(0, {ids.LEVEL - 1}), named_struct('l', 0, 'on', true), (s, l) -> IF(s.on AND ({goes}), named_struct('l', l + 1, 'on', true), named_struct('l', s.l, 'on', false)), s -> s.l)"


def histogram(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("level").agg(F.count("*").alias("n"))
