"""Spatial relations among the elements of a drawing, and the stream that uses them.

Input is e: the array of shapes.INFO of a drawing in order. A relation is STRUCT<kind, idx,
axis, spacing>.
"""

from __future__ import annotations

from . import ids
from .shapes import INFO
from .sqlgen import let

RELATION = "struct<kind:string,idx:array<int>,axis:double,spacing:double>"
#: px: alignment, spacing, size, symmetry.
ALIGN, SPACING, SIZE, SYMMETRY = 3.0, 3.0, 5.0, 5.0
ON_AXIS = 5.0
GROUP = "struct<v:double,i:int>"


def rel(kind: str, idx: str, axis: str = "cast(NULL AS DOUBLE)", spacing: str = "cast(NULL AS DOUBLE)") -> str:
    return f"named_struct('kind', '{kind}', 'idx', {idx}, 'axis', {axis}, 'spacing', {spacing})"


def grouped(values: str, tolerance: float) -> str:
    """Groups of STRUCT<v, i> in the order of v: each reaches as far as tolerance from its first value. Single ones are left out."""
    step = f"IF(size(s) > 0 AND t.v - s[size(s) - 1][0].v <= {tolerance!r}D, concat(slice(s, 1, size(s) - 1), array(concat(s[size(s) - 1], array(t)))), concat(s, array(array(t))))"
    return f"filter(aggregate(array_sort({values}), cast(array() AS ARRAY<ARRAY<{GROUP}>>), (s, t) -> {step}), x -> size(x) > 1)"


def _mean(group: str) -> str:
    return f"(aggregate({group}, 0D, (a, x) -> a + x.v) / size({group}))"


def aligned(e: str) -> str:
    """Rows (equal cy), then columns (equal cx)."""
    values = lambda axis: f"transform({e}, x -> named_struct('v', x.{axis}, 'i', x.i))"
    one = lambda kind, axis: f"transform({grouped(values(axis), ALIGN)}, g -> {rel(kind, 'array_sort(transform(g, x -> x.i))', _mean('g'))})"
    return f"concat({one('ALIGN_CENTER_H', 'cy')}, {one('ALIGN_CENTER_V', 'cx')})"


def spaced(e: str) -> str:
    """Rows and columns of three or more whose gaps are all near their mean."""
    def one(kind: str, axis: str, along: str) -> str:
        groups = grouped(f"transform({e}, x -> named_struct('v', x.{axis}, 'i', x.i))", ALIGN)
        members = f"array_sort(transform(g, (x, n) -> named_struct('v', {e}[x.i].{along}, 'n', n, 'i', x.i)))"
        made = let(
            {"o": members, "gaps": "transform(sequence(1, size(o) - 1), n -> o[n].v - o[n - 1].v)", "mean": "aggregate(gaps, 0D, (a, x) -> a + x) / size(gaps)"},
            f"IF(forall(gaps, x -> abs(x - mean) <= {SPACING!r}D), {rel(kind, 'transform(o, x -> x.i)', spacing='mean')}, NULL)", RELATION,
        )
        return f"transform(filter({groups}, g -> size(g) >= 3), g -> {made})"

    return f"filter(concat({one('EQUAL_SPACE_H', 'cy', 'cx')}, {one('EQUAL_SPACE_V', 'cx', 'cy')}), x -> x IS NOT NULL)"


def symmetric(e: str) -> str:
    """Mirror symmetry about the middle of the centres, in which every element takes part.

    Elements off the axis take, in order, the nearest free element of their size at the mirrored
    place, the first of equals.
    """
    def one(kind: str, c: str, o: str) -> str:
        near = f"sqrt(power(2 * mid - x.{c} - y.{c}, 2) + power(x.{o} - y.{o}, 2))"
        like = f"filter({e}, y -> y.i <> x.i AND NOT array_contains(s.used, y.i) AND {near} < {SYMMETRY!r}D AND abs(x.w - y.w) < {SIZE!r}D AND abs(x.h - y.h) < {SIZE!r}D)"
        best = f"array_min(transform({like}, y -> named_struct('d', {near}, 'i', y.i)))"
        grown = "named_struct('used', concat(s.used, {0}), 'hit', concat(s.hit, {1}))"
        step = let(
            {"m": best},
            f"CASE WHEN array_contains(s.used, x.i) THEN s WHEN abs(x.{c} - mid) < {SYMMETRY!r}D THEN {grown.format('array(x.i)', 'cast(array() AS ARRAY<INT>)')} "
            f"WHEN m IS NULL THEN s ELSE {grown.format('array(x.i, m.i)', 'array(x.i, m.i)')} END",
            "struct<used:array<int>,hit:array<int>>",
        )
        pairs = f"aggregate({e}, named_struct('used', cast(array() AS ARRAY<INT>), 'hit', cast(array() AS ARRAY<INT>)), (s, x) -> {step}, s -> s.hit)"
        on = f"transform(filter({e}, x -> abs(x.{c} - mid) < {SYMMETRY!r}D), x -> x.i)"
        made = let(
            {"mid": f"(array_min(transform({e}, x -> x.{c})) + array_max(transform({e}, x -> x.{c}))) / 2", "all": f"array_sort(array_union({pairs}, {on}))"},
            f"IF(size(all) >= size({e}), {rel(kind, 'all', 'mid')}, NULL)", RELATION,
        )
        return f"array({made})"

    return f"filter(concat({one('SYM_REFLECT_X', 'cx', 'cy')}, {one('SYM_REFLECT_Y', 'cy', 'cx')}), x -> x IS NOT NULL)"


def equal_sized(e: str) -> str:
    """Each element with the later free ones of its size; groups of one are none."""
    same = f"filter({e}, y -> y.i > x.i AND NOT array_contains(s.used, y.i) AND abs(x.w - y.w) < {SIZE!r}D AND abs(x.h - y.h) < {SIZE!r}D)"
    step = let(
        {"g": f"concat(array(x.i), transform({same}, y -> y.i))"},
        f"IF(array_contains(s.used, x.i) OR size(g) < 2, s, named_struct('used', concat(s.used, g), 'out', concat(s.out, array({rel('EQUAL_SIZE', 'array_sort(g)')}))))",
        f"struct<used:array<int>,out:array<{RELATION}>>",
    )
    return f"aggregate({e}, named_struct('used', cast(array() AS ARRAY<INT>), 'out', cast(array() AS ARRAY<{RELATION}>)), (s, x) -> {step}, s -> s.out)"


def relations(e: str) -> str:
    return f"IF(size({e}) < 2, cast(array() AS ARRAY<{RELATION}>), concat({aligned(e)}, {spaced(e)}, {symmetric(e)}, {equal_sized(e)}))"


REPEAT = "struct<idx:array<int>,spacing:double,row:boolean,axis:double>"


def repeat_groups(r: str) -> str:
    """Evenly spaced relations whose elements also are of one size and on one line, with that line."""
    within = lambda kind: f"filter({r}, y -> y.kind = {kind} AND size(array_except(x.idx, y.idx)) = 0)"
    made = let(
        {"line": within("IF(x.kind = 'EQUAL_SPACE_H', 'ALIGN_CENTER_H', 'ALIGN_CENTER_V')"), "sized": within("'EQUAL_SIZE'")},
        "IF(size(line) > 0 AND size(sized) > 0, named_struct('idx', x.idx, 'spacing', x.spacing, 'row', x.kind = 'EQUAL_SPACE_H', 'axis', line[0].axis), NULL)", REPEAT,
    )
    return f"filter(transform(filter({r}, x -> x.kind LIKE 'EQUAL_SPACE%'), x -> {made}), x -> x IS NOT NULL)"


def stream(bodies: str, e: str) -> str:
    """The tokens of a drawing from its elements' bodies and infos: repeated groups, then symmetric ones, then the rest."""
    state = "struct<seen:array<int>,out:array<int>>"
    sep = "IF(size(s.seen) > 0, array(3), cast(array() AS ARRAY<INT>))"
    times = f"CASE size(x.idx) - 1 WHEN 2 THEN array(67) WHEN 3 THEN array(68) WHEN 4 THEN array(69) ELSE array(70, {ids.count_id('size(x.idx) - 1')}) END"
    repeat = (
        f"named_struct('seen', array_union(s.seen, x.idx), 'out', concat(s.out, {sep}, b[x.idx[0]], array(66, IF(x.row, 60, 61), {ids.scalar_id('x.axis')}, IF(x.row, 64, 65), {ids.scalar_id('x.spacing')}), {times}))"
    )
    centre = lambda v: f"IF(x.kind = 'SYM_REFLECT_X', {e}[{v}].cx, {e}[{v}].cy)"
    shown = f"concat(filter(new, i -> abs({centre('i')} - x.axis) < {ON_AXIS!r}D), filter(new, i -> abs({centre('i')} - x.axis) >= {ON_AXIS!r}D AND {centre('i')} < x.axis))"
    mirror = let(
        {"new": "filter(x.idx, i -> NOT array_contains(s.seen, i))", "half": f"flatten(transform({shown}, (i, n) -> IF(n > 0, concat(array(3), b[i]), b[i])))"},
        f"IF(size(new) < 2, s, named_struct('seen', array_union(s.seen, x.idx), 'out', concat(s.out, {sep}, half, array(IF(x.kind = 'SYM_REFLECT_X', 62, 63), {ids.scalar_id('x.axis')}))))", state,
    )
    rest = f"IF(array_contains(s.seen, x.i), s, named_struct('seen', concat(s.seen, array(x.i)), 'out', concat(s.out, {sep}, b[x.i])))"
    start = "named_struct('seen', cast(array() AS ARRAY<INT>), 'out', cast(array() AS ARRAY<INT>))"
    repeats = f"aggregate({repeat_groups('r')}, {start}, (s, x) -> {repeat})"
    mirrors = f"aggregate(filter(r, x -> x.kind LIKE 'SYM_REFLECT%'), {repeats}, (s, x) -> {mirror})"
    return let({"b": bodies, "r": relations(e)}, f"concat(array(1), aggregate({e}, {mirrors}, (s, x) -> {rest}, s -> s.out), array(2))", "array<int>")


__all__ = ["INFO", "RELATION", "relations", "repeat_groups", "stream"]
