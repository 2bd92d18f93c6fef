"""Drawings as grey images: strokes of one width, by the distance of pixels to segments.

Curves are cut into STEPS lines in the JVM; an Arrow map then covers pixels, for all drawings of
a slice at once: each line meets the pixels of its box, and a pixel keeps the most that a line
covers of it. A line of width w covers w / 2 + 0.5 - d of a pixel at distance d, at least 0 and
at most min(w, 1). Images are levels 0 (paper) to 255 (ink), row by row. No shuffle; a slice
holds at most PIXELS of images and of candidates.

Defined results: null lines (a document that can't be read) give a null image; no lines give
white paper; lines and parts of them beyond the canvas are cut off; lines that are not finite
numbers are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import curves, ids, path
from ..functions.sqlgen import let
from ..sources import svg as source
from . import codec

STEPS = 16
PIXELS = 1 << 19
#: Fixed values of the protocol: the side of images that are compared, and the stroke that both get.
SIDE, STROKE = 256, 3.0
#: Ink is what is darker than nine tenths of white.
INK = 26


def lines(cmds: str) -> str:
    """SQL: the lines of commands without arcs, as one array of doubles x0, y0, x1, y1 and so on."""
    at = lambda axis, i: curves.at(axis, f"({i} / {STEPS}D)")
    curve = let(curves.controls("k"), f"flatten(transform(sequence(0, {STEPS - 1}), i -> array({at('x', 'i')}, {at('y', 'i')}, {at('x', '(i + 1)')}, {at('y', '(i + 1)')})))", "array<double>")
    return f"flatten(transform({cmds}, k -> CASE WHEN k.c = 'M' THEN cast(array() AS ARRAY<DOUBLE>) WHEN k.c IN ('C', 'Q') THEN {curve} ELSE array(k.sx, k.sy, k.ex, k.ey) END))"


def document_lines(df: DataFrame, strict: bool = False, **texts: str) -> DataFrame:
    """df with the lines of SVG columns (new column -> SVG column) on the canvas, view box and transforms applied; null where one can't be read.

    strict: a document that can't be read is an error.
    """
    rows = source.parse(df, **{f"_doc_{name}": svg for name, svg in texts.items()})
    if strict:
        for name in texts:
            failed = F.raise_error(F.concat(F.lit("document can't be rendered: "), F.col(f"_doc_{name}.error")))
            rows = rows.withColumn(f"_doc_{name}", F.when(F.col(f"_doc_{name}.error").isNotNull(), failed).otherwise(F.col(f"_doc_{name}")))
    # In two steps: as one, the expression would be too deep for the analyser.
    rows = rows.withColumns({f"_drawn_{name}": F.expr(f"IF(_doc_{name}.error IS NULL, {codec.elements_of(f'_doc_{name}')}, NULL)") for name in texts})
    rows = rows.withColumns({name: F.expr(f"flatten(transform(_drawn_{name}, e -> {lines('e')}))") for name in texts})
    return rows.drop(*[f"_{kind}_{name}" for kind in ("doc", "drawn") for name in texts])


def rasterise(column: pa.ListArray, side: int, stroke: float, canvas: float = ids.CANVAS) -> np.ndarray:
    """Images of side * side levels of each of a column of lines; the stroke is measured on the canvas."""
    out = np.zeros(len(column) * side * side, np.uint8)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float)
    owner = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) // 4)
    segs = flat.reshape(-1, 4) * (side / canvas)
    good = np.isfinite(segs).all(1)
    segs, owner = segs[good], owner[good]
    w = stroke * side / canvas
    pad = w / 2 + 0.5
    least = np.clip(np.ceil(np.minimum(segs[:, :2], segs[:, 2:]) - pad - 0.5), 0, side).astype(np.int64)
    most = np.clip(np.floor(np.maximum(segs[:, :2], segs[:, 2:]) + pad - 0.5), -1, side - 1).astype(np.int64)
    across = np.maximum(most - least + 1, 0)
    count = across[:, 0] * across[:, 1]
    ends = np.cumsum(count)
    a = 0
    while a < len(segs):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIXELS, "right")))
        k = np.repeat(np.arange(a, b), count[a:b])
        nth = np.arange(len(k)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
        col, row = least[k, 0] + nth % across[k, 0], least[k, 1] + nth // across[k, 0]
        x0, y0 = segs[k, 0], segs[k, 1]
        dx, dy, px, py = segs[k, 2] - x0, segs[k, 3] - y0, col + 0.5, row + 0.5
        long = dx * dx + dy * dy
        t = np.clip(np.divide((px - x0) * dx + (py - y0) * dy, long, out=np.zeros(len(k)), where=long > 0), 0, 1)
        qx, qy = x0 + t * dx - px, y0 + t * dy - py
        cover = np.maximum(0.0, np.minimum(min(w, 1.0), pad - np.sqrt(qx * qx + qy * qy)))
        np.maximum.at(out, (owner[k] * side + row) * side + col, np.floor(cover * 255 + 0.5).astype(np.uint8))
        a = b
    return out.reshape(len(column), side, side)


def _box(x: np.ndarray, win: int) -> np.ndarray:
    """Means of the win * win pixels around each of a stack of images, whose edges go on beyond them."""
    r = win // 2
    p = np.pad(x, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge")
    p[:, 0, :] = p[:, :, 0] = 0
    s = p.cumsum(1).cumsum(2)
    n = 2 * r + 1
    return (s[:, n:, n:] - s[:, :-n, n:] - s[:, n:, :-n] + s[:, :-n, :-n]) / (n * n)


def ssim(a: np.ndarray, b: np.ndarray, win: int = 7) -> np.ndarray:
    """Mean structural similarity of two stacks of images in [0, 1], with a box window."""
    ma, mb = _box(a, win), _box(b, win)
    va, vb, cov = _box(a * a, win) - ma * ma, _box(b * b, win) - mb * mb, _box(a * b, win) - ma * mb
    score = (2 * ma * mb + 1e-4) * (2 * cov + 9e-4) / np.maximum((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4), 1e-12)
    return np.clip(score.mean((1, 2)), -1.0, 1.0)


def _mapped(df: DataFrame, columns: list[str], added: dict[str, pa.DataType], kinds: str, side: int, make) -> DataFrame:
    """df less columns, with what make gives for slices of them (images that a slice makes: PIXELS at most)."""
    kept = [f for f in df.schema if f.name not in columns]
    step = max(1, PIXELS // (side * side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                new = make([part.column(c) for c in columns])
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [pa.array(v, t) for v, t in zip(new, added.values(), strict=True)], names=[f.name for f in kept] + list(added))

    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [kinds]))


def with_image(df: DataFrame, column: str, side: int = SIDE, stroke: float = STROKE) -> DataFrame:
    """df with image (levels, as binary), n_ink (pixels darker than nine tenths of white) and level_sum instead of a column of lines."""

    def make(columns):
        images = rasterise(columns[0], side, stroke)
        null = columns[0].is_null().to_pylist()
        pick = lambda v: [None if z else x for z, x in zip(null, v, strict=True)]
        return pick([i.tobytes() for i in images]), pick((images >= INK).sum((1, 2)).tolist()), pick(images.sum((1, 2), dtype=np.int64).tolist())

    return _mapped(df, [column], {"image": pa.binary(), "n_ink": pa.int32(), "level_sum": pa.int64()}, "image binary, n_ink int, level_sum long", side, make)


def with_similarity(df: DataFrame, a: str, b: str, side: int = SIDE, stroke: float = STROKE, name: str = "render_ssim") -> DataFrame:
    """df with the similarity of the images of two columns of lines, instead of these; 0 where one is null, as it can't be rendered."""

    def make(columns):
        paper = lambda c: 1 - rasterise(c, side, stroke) / 255.0
        failed = pc.or_(columns[0].is_null(), columns[1].is_null()).to_numpy(zero_copy_only=False)
        return [np.where(failed, 0.0, ssim(paper(columns[0]), paper(columns[1])))]

    return _mapped(df, [a, b], {name: pa.float64()}, f"`{name}` double", 4 * side, make)


def with_mask(df: DataFrame, column: str, side: int = 64, stroke: float = 1.0) -> DataFrame:
    """df with ink (the inked share of an image of twice the side) and mask (booleans of side * side: any ink in two by two), instead of a column of lines."""

    def make(columns):
        inked = rasterise(columns[0], 2 * side, stroke) >= INK
        null = columns[0].is_null().to_pylist()
        masks = inked.reshape(-1, side, 2, side, 2).any((2, 4)).reshape(len(inked), -1)
        return [[None if z else x for z, x in zip(null, v, strict=True)] for v in (inked.mean((1, 2)).tolist(), list(masks))]

    return _mapped(df, [column], {"ink": pa.float64(), "mask": pa.list_(pa.bool_())}, "ink double, mask array<boolean>", 2 * side, make)


def of_elements(df: DataFrame, elements: str = "elements", name: str = "lines") -> DataFrame:
    """df with the lines of elements' commands."""
    return df.withColumn(name, F.expr(f"flatten(transform({elements}, e -> {lines(path.without_arcs('e'))}))"))
