"""Elements of decoded streams.

An Arrow step makes the elements of streams that draw paths only, a batch at a time in numpy; streams
with shapes decode by the fold of functions.decode and pass through it. A spatial token makes elements
from all those before it, so the step takes the groups and texts which the fold has made of those streams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decode, ids
from ..functions.sqlgen import let

MOST_COPIES = 64
STYLE = decode.STYLE
#: tag -> attributes that place it.
PLACED = {"circle": ("cx", "cy", "r"), "ellipse": ("cx", "cy", "rx", "ry"), "rect": ("x", "y", "width", "height")}


#: Coordinates of the commands M L H V C Q A Z, from 10 on, and the forms that these have in a path's text.
NEED = np.array([1, 1, 1, 1, 3, 2, 2, 0])
FORMS = [" {x} {y}", ", {x} {y}", " {x}", " {y}", " {x} {y} 0 0 1"]
FORM = np.array([[0, 0, 0], [0, 0, 0], [2, 2, 2], [3, 3, 3], [0, 1, 1], [0, 1, 1], [4, 0, 0], [0, 0, 0]])
#: Canvases up to which the step makes the texts; numbers of larger ones may not be decimals of the fold's.
WIDEST = 1e12


def path_only(tokens: str) -> str:
    """SQL: whether a stream has only commands, coordinates, markers, separators and brackets."""
    return f"coalesce(forall({tokens}, t -> {ids.is_coord('t')} OR (t >= 10 AND t < 18) OR (t >= 1 AND t <= 3) OR (t >= 30 AND t < 34) OR (t >= 40 AND t < 56)), false)"


@lru_cache(1 << 17)
def _place(t: int, canvas: float, form: int) -> str:
    """A coordinate id's centre in one of FORMS, at one decimal: ties of the shortest decimal form go to even, as bround() does."""
    level = next(k for k in range(ids.LEVEL + 1) if t < ids.level_base(k + 1))
    row, column = divmod(t - ids.level_base(level), 2**level)
    number = lambda q: str(Decimal(repr((q + 0.5) * (canvas / 2**level))).quantize(Decimal("0.1"), ROUND_HALF_EVEN)).rstrip("0").rstrip(".")
    return FORMS[form].format(x=number(column), y=number(row))


def drawn_paths(streams: pa.ListArray, canvases: list[float]) -> pa.ListArray:
    """The elements of path_only() streams, none of them null: a path for each run of commands between separators that says something.

    A command has the coordinates after it, up to a separator or bracket; one that has too few says nothing.
    """
    v, sizes = streams.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(streams).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    row, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(v))
    command, coord = (v >= 10) & (v < 18), v >= ids.BASE
    # The command, separator or bracket that a token comes after, which is in its own stream or none.
    last = np.maximum.accumulate(np.where(command | (v < 4), at, 0)) if len(v) else at
    held = coord & command[last] & (last >= starts[row])
    nth = np.cumsum(held)
    nth = nth - nth[last] - 1
    kind = np.where(command, v - 10, 0)
    said = command & (np.bincount(last[held], minlength=len(v)) >= NEED[kind])
    used = held & said[last] & (nth < NEED[kind[last]])
    kept = np.flatnonzero(said | used)
    # Runs of commands: new at each stream and separator; the kept tokens of one are its path.
    begins = np.bincount(starts[:-1][sizes > 0], minlength=len(v)) > 0
    run = np.cumsum(begins | (v == 3))[kept]
    first = np.concatenate([[True], run[1:] != run[:-1]])[: len(kept)]
    names, canvas = np.unique(np.asarray(canvases, np.float64), return_inverse=True)
    code = np.where(said[kept], kind[kept] * 2 + first, 0)
    mine = ~said[kept]
    place = kept[mine]
    keys = (canvas[row[place]] * ids.VOCAB + v[place]) * len(FORMS) + FORM[kind[last[place]], nth[place]]
    keys, which = np.unique(keys, return_inverse=True)
    code[mine] = 16 + which
    texts = [(" " * (1 - i)) + c for c in "MLHVCQAZ" for i in (0, 1)]
    texts += [_place(t % ids.VOCAB, float(names[t // ids.VOCAB]), f) for t, f in (divmod(k, len(FORMS)) for k in keys.tolist())]
    heads = np.flatnonzero(first)
    parts = pa.ListArray.from_arrays(pa.array(np.append(heads, len(kept)), pa.int32()), pa.array(texts, pa.string()).take(pa.array(code)))
    made = pc.binary_join_element_wise('<path d="', pc.binary_join(parts, ""), f'" {STYLE}/>', "")
    n = np.bincount(row[kept[heads]], minlength=len(sizes))
    if (n == 0).any():  # a stream that says nothing is one path of all its coordinates, whatever lies between, which is mostly empty
        made, where = made.to_pylist(), np.cumsum(n) - n
        lists = [made[a : a + k] if k else None for a, k in zip(where.tolist(), n.tolist(), strict=True)]
        for i in np.flatnonzero(n == 0).tolist():
            flat = v[starts[i] : starts[i + 1]]
            flat = flat[(flat >= ids.BASE) | ((flat >= 10) & (flat < 18))]
            again = drawn_paths(pa.array([np.append(17, flat)], pa.list_(pa.int32())), [canvases[i]]).to_pylist()[0][0] if len(flat) else ""
            d = again[len('<path d="') : -len(f'" {STYLE}/>')].removeprefix("Z").removeprefix(" ")
            lists[i] = [f'<path d="{d}" fill="none" stroke="black" stroke-width="1.0"/>']
        return pa.array(lists, pa.list_(pa.string()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), made)


def with_elements(df: DataFrame, tokens: str, name: str, canvas: float | str = ids.CANVAS, level: int | str = ids.LEVEL) -> DataFrame:
    """df with the SVG elements of each stream; canvas and deepest level are numbers or columns."""
    spatial = F.expr(f"exists({tokens}, t -> t >= 60 AND t < 71)")
    plain = F.expr(f"{path_only(tokens)} AND coalesce({ids.number(canvas)} <= {WIDEST!r}D, false)")
    groups = f"IF(exists({tokens}, t -> t >= 60 AND t < 71), {decode.groups(tokens)}, cast(array() AS ARRAY<STRUCT<c:INT,v:ARRAY<INT>>>))"
    text = let({"c": "g.c", "v": "g.v"}, f"IF(c < 18, {decode.group_text(canvas=canvas)}, IF(c < 60, {decode.shape_text(canvas=canvas, level=level)}, ''))", "string")
    rows = df.withColumn("_plain", plain).withColumn(name, F.when(~F.col("_plain") & ~spatial, F.expr(decode.element_list(tokens, canvas, level))))
    rows = rows.withColumn("_groups", F.expr(f"transform({groups}, g -> named_struct('c', g.c, 'v', g.v, 'x', {text}))"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_groups", "_plain").schema)
    at = rows.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("_groups", "_plain")}
            each = lambda v, mask: batch.column(v).filter(mask).to_pylist() if isinstance(v, str) else [float(v)] * pc.sum(mask).as_py()  # noqa: B023, E731
            made = pc.list_value_length(batch.column("_groups"))
            if pc.max(made).as_py():  # else no stream of the batch has spatial tokens
                groups, all_ = batch.column("_groups").to_pylist(), pa.array([True] * len(batch))
                rows = zip(batch.column(at).to_pylist(), groups, each(canvas, all_), batch.column(level).to_pylist() if isinstance(level, str) else [level] * len(groups), strict=True)
                kept[name] = pa.array([e if not g else arranged(g, c, k) for e, g, c, k in rows], pa.list_(pa.string()))
            mask = batch.column("_plain")
            if pc.any(mask).as_py():
                paths = drawn_paths(batch.column(tokens).filter(mask), each(canvas, mask))
                flags = mask.to_numpy(zero_copy_only=False)
                others = kept[name].filter(pc.invert(mask)).cast(paths.type)
                place = np.where(flags, np.cumsum(flags) - 1, len(paths) + np.cumsum(~flags) - 1)
                kept[name] = pa.concat_arrays([paths, others]).take(pa.array(place)) if len(others) else paths
            yield pa.RecordBatch.from_arrays([*kept.values()], names=[*kept])

    return rows.mapInArrow(run, kinds)


def _scalar(t: int, level: int) -> int | None:
    deep, side = t - ids.level_base(level), 2**level
    return None if deep < 0 else deep % side * side + deep // side


def _text(v: float) -> str:
    return f"{v:.1f}".rstrip("0").rstrip(".")


def _moved(element: str, place) -> str | None:
    """A shape element with new attribute values from place(tag, values); None for paths."""
    m = re.match(r"<(circle|ellipse|rect) ", element)
    if not m:
        return None
    names = PLACED[m[1]]
    values = {n: float(re.search(rf' {n}="([^"]+)"', element)[1]) for n in names}
    values |= place(m[1], values)
    return f"<{m[1]} " + " ".join(f'{n}="{_text(values[n])}"' for n in names) + f" {STYLE}/>"


def _mirrored(element: str, axis: float, x: bool) -> str | None:
    def place(tag: str, v: dict) -> dict:
        if tag == "rect":
            return {"x": 2 * axis - v["x"] - v["width"]} if x else {"y": 2 * axis - v["y"] - v["height"]}
        return {"cx": 2 * axis - v["cx"]} if x else {"cy": 2 * axis - v["cy"]}

    return _moved(element, place)


def _shifted(element: str, dx: float, dy: float) -> str | None:
    return _moved(element, lambda tag, v: {"x": v["x"] + dx, "y": v["y"] + dy} if tag == "rect" else {"cx": v["cx"] + dx, "cy": v["cy"] + dy})


def arranged(groups: list[dict], canvas: float = ids.CANVAS, level: int = ids.LEVEL) -> list[str]:
    """Elements of a stream with spatial tokens, from its groups and their texts.

    A reflection repeats every element before it. EQUAL_SIZE begins a header of alignments,
    spacings and a repeat, which copies the last element; paths are not copied. Alone, an
    alignment, spacing or repeat makes nothing.
    """
    out: list[str] = []
    path: list[str] = []
    top = 4**level - 1

    def close() -> None:
        if path:
            out.append(f'<path d="{" ".join(path)}" {STYLE}/>')
            path.clear()

    i = 0
    while i < len(groups):
        c, v, text = groups[i]["c"], groups[i]["v"], groups[i]["x"]
        i += 1
        if 10 <= c < 18:
            if text:
                path.append(text)
            continue
        close()
        if c in (62, 63):
            code = _scalar(v[0], level) if v else None
            if code is not None:
                axis = code / top * canvas
                out += [m for m in (_mirrored(e, axis, c == 62) for e in list(out)) if m]
        elif c == 66:
            align = space = None
            count = 0
            if v:  # coordinates right after the marker end its header
                continue
            while i < len(groups) and 60 <= groups[i]["c"] < 71:
                k, w = groups[i]["c"], groups[i]["v"]
                if k in (62, 63, 66):
                    break
                i += 1
                first = _scalar(w[0], level) if w else None
                if k in (60, 61):
                    align = k
                elif k in (64, 65):
                    space = None if first is None else first / top * canvas
                else:
                    count = {67: 2, 68: 3, 69: 4}.get(k, 0 if first is None else min(first, MOST_COPIES))
                    break
                if len(w) > 1:
                    break
            if out and count and space is not None:
                along = align == 60 or (space and align is None)
                out += [m for m in (_shifted(out[-1], space * n if along else 0, 0 if along else space * n) for n in range(1, count + 1)) if m]
        elif 20 <= c < 24 and text:
            out.append(text)
    close()
    return out or [f'<path d="" fill="none" stroke="black" stroke-width="1.0"/>']
