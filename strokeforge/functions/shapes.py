"""Shapes in the commands of an element, and their tokens.

A shape is STRUCT<shape, a, b, p, confidence>: kind, first and last command, parameters (circle
cx cy r; ellipse cx cy rx ry; rect x y w h; round_rect x y w h rx ry).
"""

from __future__ import annotations

from . import ids, tokens
from .path import COMMANDS
from .sqlgen import let, scan

SHAPE = "struct<shape:string,a:int,b:int,p:array<double>,confidence:double>"
#: px, px, cosine.
ROUND_TOLERANCE, RECT_TOLERANCE, ANGLE_TOLERANCE = 5.0, 3.0, 0.15
SPAN = "struct<a:int,b:int>"


def subpaths(cmds: str) -> str:
    """First and last index of each run from a move to a close; later moves begin anew, unclosed runs are none."""
    none = f"cast(array() AS ARRAY<{SPAN}>)"
    step = lambda s: (
        f"named_struct('st', named_struct('a', CASE x.c WHEN 'M' THEN x.i WHEN 'Z' THEN cast(NULL AS INT) ELSE {s}.a END), "
        f"'out', IF(x.c = 'Z' AND {s}.a IS NOT NULL, array(named_struct('a', {s}.a, 'b', x.i)), {none}))"
    )
    return scan(f"transform({cmds}, (k, i) -> named_struct('c', k.c, 'i', i))", "x", "named_struct('a', cast(NULL AS INT))", "struct<a:int>", SPAN, step)


def _shape(kind: str, p: list[str], confidence: str) -> str:
    return f"named_struct('shape', {kind}, 'a', cast(z.a AS INT), 'b', cast(z.b AS INT), 'p', array({', '.join(p)}), 'confidence', {confidence})"


def _dist(a: str, b: str) -> str:
    return f"sqrt(power({a}.x - {b}.x, 2) + power({a}.y - {b}.y, 2))"


def round_shape() -> str:
    """A circle or ellipse from four cubics, or null; s holds the commands, z their span."""
    pt = lambda i: f"named_struct('x', s[{i}].ex, 'y', s[{i}].ey)"
    t = ROUND_TOLERANCE
    mid = lambda a, b: f"named_struct('x', ({a}.x + {b}.x) / 2, 'y', ({a}.y + {b}.y) / 2)"
    far = lambda a, b, axis: f"greatest(abs({a}.{axis} - m.{axis}), abs({b}.{axis} - m.{axis}))"
    radii = (
        f"CASE WHEN {far('p0', 'p2', 'y')} < {t} AND {far('p1', 'p3', 'x')} < {t} THEN array({far('p0', 'p2', 'x')}, {far('p1', 'p3', 'y')}) "
        f"WHEN {far('p0', 'p2', 'x')} < {t} AND {far('p1', 'p3', 'y')} < {t} THEN array({far('p1', 'p3', 'x')}, {far('p0', 'p2', 'y')}) "
        f"WHEN array_max(ds) - array_min(ds) < {t} THEN array((ds[0] + ds[1] + ds[2] + ds[3]) / 4, (ds[0] + ds[1] + ds[2] + ds[3]) / 4) END"
    )
    conf = f"greatest(0.5D, 1 - {_dist('m1', 'm2')} / {t}D)"
    circle = _shape("'circle'", ["m.x", "m.y", "(r[0] + r[1]) / 2"], conf)
    oval = _shape("'ellipse'", ["m.x", "m.y", "r[0]", "r[1]"], conf)
    body = let(
        {
            **{f"p{i}": pt(i) for i in range(5)}, "m1": mid("p0", "p2"), "m2": mid("p1", "p3"), "m": mid("m1", "m2"),
            "ds": "array(" + ", ".join(_dist("m", f"p{i}") for i in range(4)) + ")", "r": radii,
        },
        f"CASE WHEN {_dist('p0', 'p4')} > {2 * t} OR {_dist('m1', 'm2')} > {t} OR r IS NULL OR r[0] < 1 OR r[1] < 1 THEN NULL WHEN abs(r[0] - r[1]) < {t} THEN {circle} ELSE {oval} END",
        SHAPE,
    )
    return f"IF(letters = 'MCCCCZ', {body}, NULL)"


def rect_shape() -> str:
    edge = lambda i: f"named_struct('x', s[{(i + 1) % 4}].ex - s[{i}].ex, 'y', s[{(i + 1) % 4}].ey - s[{i}].ey, 'n', sqrt(power(s[{(i + 1) % 4}].ex - s[{i}].ex, 2) + power(s[{(i + 1) % 4}].ey - s[{i}].ey, 2)))"
    square = " AND ".join(f"q[{i}].n >= 0.1 AND abs((q[{i}].x * q[{(i + 1) % 4}].x + q[{i}].y * q[{(i + 1) % 4}].y) / (q[{i}].n * q[{(i + 1) % 4}].n)) <= {ANGLE_TOLERANCE}" for i in range(4))
    long_enough = "q[0].n >= 0.1 AND q[1].n >= 0.1 AND q[2].n >= 0.1 AND q[3].n >= 0.1"
    even = f"abs(q[0].n - q[2].n) <= {RECT_TOLERANCE} AND abs(q[1].n - q[3].n) <= {RECT_TOLERANCE}"
    xs, ys = ("array(" + ", ".join(f"s[{i}].{a}" for i in range(4)) + ")" for a in ("ex", "ey"))
    body = let(
        {"q": f"array({', '.join(edge(i) for i in range(4))})", "xs": xs, "ys": ys, "w": "array_max(xs) - array_min(xs)", "h": "array_max(ys) - array_min(ys)"},
        f"IF({long_enough}, IF({square} AND {even} AND w >= 1 AND h >= 1, {_shape("'rect'", ['array_min(xs)', 'array_min(ys)', 'w', 'h'], '1D')}, NULL), NULL)",
        SHAPE,
    )
    return f"IF(letters RLIKE '^M[LHV]{{3,4}}Z$', {body}, NULL)"


def rounded_shape() -> str:
    body = let(
        {
            "pts": "slice(s, 1, size(s) - 1)", "xs": "transform(pts, k -> k.ex)", "ys": "transform(pts, k -> k.ey)", "cs": "filter(s, k -> k.c IN ('A', 'C'))",
            "w": "array_max(xs) - array_min(xs)", "h": "array_max(ys) - array_min(ys)",
            "rx": "aggregate(cs, 0D, (a, k) -> a + abs(k.ex - k.sx)) / size(cs)", "ry": "aggregate(cs, 0D, (a, k) -> a + abs(k.ey - k.sy)) / size(cs)",
        },
        f"IF(size(pts) >= 8 AND w >= 2 AND h >= 2 AND rx >= 0.5 AND ry >= 0.5 AND rx <= w / 2 + {RECT_TOLERANCE} AND ry <= h / 2 + {RECT_TOLERANCE}, "
        f"{_shape("'round_rect'", ['array_min(xs)', 'array_min(ys)', 'w', 'h', 'rx', 'ry'], '0.85D')}, NULL)",
        SHAPE,
    )
    return f"IF(letters RLIKE '^M.*Z$' AND size(s) >= 8 AND length(regexp_replace(letters, '[^AC]', '')) = 4 AND length(regexp_replace(letters, '[^LHV]', '')) >= 3, {body}, NULL)"


def detected(cmds: str) -> str:
    """All shapes among closed runs of commands: a round one first, then a rectangle, then a rounded one."""
    one = let(
        {"s": f"slice({cmds}, z.a + 1, z.b - z.a + 1)", "letters": "array_join(transform(s, k -> k.c), '')"},
        f"coalesce({round_shape()}, {rect_shape()}, {rounded_shape()})", SHAPE,
    )
    return f"filter(transform({subpaths(cmds)}, z -> {one}), x -> x IS NOT NULL)"


def shape_tokens(x: str = "x") -> str:
    sc = lambda i: ids.scalar_id(f"{x}.p[{i}]")
    at = ids.coord_id(f"{x}.p[0]", f"{x}.p[1]")
    return (
        f"CASE {x}.shape WHEN 'circle' THEN array(20, {at}, {sc(2)}) WHEN 'ellipse' THEN array(21, {at}, {sc(2)}, {sc(3)}) "
        f"WHEN 'rect' THEN array(22, {at}, {sc(2)}, {sc(3)}) ELSE array(23, {at}, {sc(2)}, {sc(3)}, {sc(4)}, {sc(5)}) END"
    )


def composite(cmds: str) -> str:
    """The body of an element with shapes as macro tokens and what is left bare; with no shape, with all markers."""
    none = "cast(array() AS ARRAY<INT>)"
    bare = f"concat(array({tokens.letter_id()}), {tokens.coords()})"
    item = let({"here": "filter(found, x -> x.a <= i AND i <= x.b)"}, f"CASE WHEN size(here) = 0 THEN {bare} WHEN here[0].a = i THEN {let({'x': 'here[0]'}, shape_tokens(), 'array<int>')} ELSE {none} END", "array<int>")
    return let({"found": detected(cmds)}, f"IF(size(found) = 0, {tokens.full(cmds)}, flatten(transform({cmds}, (k, i) -> {item})))", "array<int>")


INFO = "struct<i:int,kind:string,cx:double,cy:double,x0:double,y0:double,x1:double,y1:double,w:double,h:double>"


def info(cmds: str, i: str) -> str:
    """Place and size of element number i: of its first shape, else of its end points."""
    f = lambda kind, x0, y0, x1, y1, cx, cy, w, h: f"named_struct('i', cast({i} AS INT), 'kind', {kind}, 'cx', {cx}, 'cy', {cy}, 'x0', {x0}, 'y0', {y0}, 'x1', {x1}, 'y1', {y1}, 'w', {w}, 'h', {h})"
    oval = let({"rx": "x.p[2]", "ry": "IF(x.shape = 'circle', x.p[2], x.p[3])"}, f("x.shape", "x.p[0] - rx", "x.p[1] - ry", "x.p[0] + rx", "x.p[1] + ry", "x.p[0]", "x.p[1]", "2 * rx", "2 * ry"), INFO)
    box = f("x.shape", "x.p[0]", "x.p[1]", "x.p[0] + x.p[2]", "x.p[1] + x.p[3]", "x.p[0] + x.p[2] / 2", "x.p[1] + x.p[3] / 2", "x.p[2]", "x.p[3]")
    least = lambda a, b: f"array_min(transform({cmds}, k -> least(k.{a}, k.{b})))"
    most = lambda a, b: f"array_max(transform({cmds}, k -> greatest(k.{a}, k.{b})))"
    plain = let({"a": least("sx", "ex"), "b": least("sy", "ey"), "c": most("sx", "ex"), "d": most("sy", "ey")}, f("'path'", "a", "b", "c", "d", "(a + c) / 2", "(b + d) / 2", "c - a", "d - b"), INFO)
    empty = f("'path'", *["0D"] * 8)
    return let({"x": f"get({detected(cmds)}, 0)"}, f"CASE WHEN x.shape IN ('circle', 'ellipse') THEN {oval} WHEN x IS NOT NULL THEN {box} WHEN size({cmds}) = 0 THEN {empty} ELSE {plain} END", INFO)


__all__ = ["COMMANDS", "SHAPE", "composite", "detected", "info", "shape_tokens", "subpaths"]
