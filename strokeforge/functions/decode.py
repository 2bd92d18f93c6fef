"""Decoding of streams to path text and SVG: groups by one scan over the tokens, texts by group.

A group is a command or shape with the coordinates that follow it. Groups of commands make
path texts, which join into one path until a SEP, a shape or a spatial token ends it; shapes
make elements of their own. Streams with spatial tokens need all earlier elements at once and
are decoded by operators.detok instead.
"""

from __future__ import annotations

from . import ids
from .grammar import struct
from .sqlgen import let, scan, trimmed

STYLE = 'fill="none" stroke="black" stroke-width="1"'


def group_text(c: str = "c", v: str = "v", canvas: float | str = ids.CANVAS) -> str:
    """The path text of command c with coordinate ids v; empty if it has too few."""
    x = lambda i: trimmed(ids.x_of(f"{v}[{i}]", canvas), 1)
    y = lambda i: trimmed(ids.y_of(f"{v}[{i}]", canvas), 1)
    xy = lambda i: f"concat({x(i)}, ' ', {y(i)})"
    n = f"size({v})"
    return (
        f"CASE WHEN {c} = 10 AND {n} >= 1 THEN concat('M ', {xy(0)}) WHEN {c} = 11 AND {n} >= 1 THEN concat('L ', {xy(0)}) WHEN {c} = 12 AND {n} >= 1 THEN concat('H ', {x(0)}) "
        f"WHEN {c} = 13 AND {n} >= 1 THEN concat('V ', {y(0)}) WHEN {c} = 14 AND {n} >= 3 THEN concat('C ', {xy(0)}, ', ', {xy(1)}, ', ', {xy(2)}) "
        f"WHEN {c} = 15 AND {n} >= 2 THEN concat('Q ', {xy(0)}, ', ', {xy(1)}) WHEN {c} = 16 AND {n} >= 2 THEN concat('A ', {x(0)}, ' ', {y(0)}, ' 0 0 1 ', {xy(1)}) WHEN {c} = 17 THEN 'Z' ELSE '' END"
    )


def shape_text(c: str = "c", v: str = "v", canvas: float | str = ids.CANVAS, level: int | str = ids.LEVEL) -> str:
    """The element of shape c; empty if it lacks coordinates or a scalar isn't of the deepest level."""
    x, y = trimmed(ids.x_of(f"{v}[0]", canvas), 2), trimmed(ids.y_of(f"{v}[0]", canvas), 2)
    s = lambda i: trimmed(ids.scalar_of(f"{v}[{i}]", canvas, level), 2)
    deep = lambda n: f"size({v}) > {n} AND forall(slice({v}, 2, {n}), z -> z >= {ids.first_id(level)})"
    a = lambda tag, *pairs: "concat(" + ", ".join([f"'<{tag}'", *[z for k, val in pairs for z in (f"' {k}=\"'", val, "'\"'")], f"' {STYLE}/>'"]) + ")"
    return (
        f"CASE WHEN {c} = 20 AND {deep(1)} THEN {a('circle', ('cx', x), ('cy', y), ('r', s(1)))} WHEN {c} = 21 AND {deep(2)} THEN {a('ellipse', ('cx', x), ('cy', y), ('rx', s(1)), ('ry', s(2)))} "
        f"WHEN {c} = 22 AND {deep(2)} THEN {a('rect', ('x', x), ('y', y), ('width', s(1)), ('height', s(2)))} "
        f"WHEN {c} = 23 AND {deep(4)} THEN {a('rect', ('x', x), ('y', y), ('width', s(1)), ('height', s(2)), ('rx', s(3)), ('ry', s(4)))} ELSE '' END"
    )


GROUP = "struct<c:int,v:array<int>>"


def groups(tokens: str) -> str:
    """Array of STRUCT<c INT, v ARRAY<INT>> in order: c is the id that opened a group, 3 for SEP; v its coordinates."""
    none = "cast(array() AS ARRAY<INT>)"
    opens = "((t >= 10 AND t < 18) OR (t >= 20 AND t < 24) OR (t >= 60 AND t < 71))"
    keeps = "((t >= 30 AND t < 34) OR (t >= 40 AND t < 56))"
    ended = lambda s: f"IF({s}.c IS NULL, cast(array() AS array<{GROUP}>), array(named_struct('c', {s}.c, 'v', {s}.v)))"

    def step(s: str) -> str:
        # Markers leave a command open and close a shape; so does any other id.
        state = {
            "open": f"CASE WHEN {opens} THEN true WHEN {ids.is_coord('t')} THEN {s}.open WHEN {keeps} THEN {s}.open AND {s}.c < 18 ELSE false END",
            "c": f"IF({opens} OR t = 3, t, {s}.c)", "v": f"CASE WHEN {opens} OR t = 3 THEN {none} WHEN {ids.is_coord('t')} AND {s}.open THEN concat({s}.v, array(t)) ELSE {s}.v END",
        }
        return struct({"st": struct(state), "out": f"IF({opens} OR t = 3, {ended(s)}, cast(array() AS array<{GROUP}>))"})

    start = f"named_struct('open', false, 'c', cast(NULL AS INT), 'v', {none})"
    return scan(tokens, "t", start, "struct<open:boolean,c:int,v:array<int>>", GROUP, step, ended)


def path_text(tokens: str, canvas: float | str = ids.CANVAS) -> str:
    """All commands of a stream as one path text; coordinates go to the last command whatever lies between."""
    flat = f"filter({tokens}, t -> (t >= 10 AND t < 18) OR {ids.is_coord('t')})"
    return f"array_join(filter(transform({groups(flat)}, g -> {let({'c': 'g.c', 'v': 'g.v'}, group_text(canvas=canvas), 'string')}), x -> x <> ''), ' ')"


def element_list(tokens: str, canvas: float | str = ids.CANVAS, level: int | str = ids.LEVEL) -> str:
    """The elements of a stream without spatial tokens; one path, maybe empty, if it decodes to none."""
    text = let({"c": "g.c", "v": "g.v"}, f"IF(c < 18, {group_text(canvas=canvas)}, {shape_text(canvas=canvas, level=level)})", "string")
    # Groups that are no commands end the path before them, as the end does; they may be shapes themselves.
    cuts = "filter(sequence(0, size(gs)), i -> coalesce(gs[i].c < 10 OR gs[i].c >= 18, false) OR i = size(gs))".replace("gs[i]", "get(gs, i)")
    joined = "array_join(filter(slice(xs, lo + 1, i - lo), x -> x <> ''), ' ')"
    path = let({"lo": "IF(n = 0, 0, cs[n - 1] + 1)", "d": joined}, f"IF(d = '', cast(array() AS ARRAY<STRING>), array(concat('<path d=\"', d, '\" {STYLE}/>')))", "array<string>")
    shape = "IF(get(gs, i).c >= 18 AND xs[i] <> '', array(xs[i]), cast(array() AS ARRAY<STRING>))".replace("xs[i]", "get(xs, i)")
    made = let({"gs": groups(tokens), "xs": f"transform(gs, g -> {text})", "cs": cuts}, f"flatten(transform(cs, (i, n) -> concat({path}, coalesce({shape}, cast(array() AS ARRAY<STRING>)))))", "array<string>")
    alone = f"array(concat('<path d=\"', {path_text(tokens, canvas)}, '\" fill=\"none\" stroke=\"black\" stroke-width=\"1.0\"/>'))"
    return let({"els": made}, f"IF(size(els) > 0, els, {alone})", "array<string>")


def document(elements: str, canvas: float | str = ids.CANVAS) -> str:
    if isinstance(canvas, str):
        size = f"IF({canvas} = floor({canvas}), cast(cast({canvas} AS BIGINT) AS STRING), cast({canvas} AS STRING))"
    else:
        size = f"'{int(canvas) if float(canvas).is_integer() else canvas}'"
    head = f"""'<svg xmlns="http://www.w3.org/2000/svg" width="', {size}, '" height="', {size}, '" viewBox="0 0 ', {size}, ' ', {size}, '">'"""
    return f"concat({head}, '\\n  ', array_join({elements}, '\\n  '), '\\n</svg>')"


def expected_fidelity(tokens: str, canvas: float | str = ids.CANVAS) -> str:
    """STRUCT<coord_mean_px, coord_max_px>: what quantising costs at the coarsest level used."""
    level = f"array_min(filter(transform({tokens}, t -> {ids.level_of('t')}), z -> z IS NOT NULL))"
    size = f"({ids.number(canvas)} / power(2D, lv))"
    return let({"lv": level}, f"named_struct('coord_mean_px', IF(lv IS NULL, 0D, round(0.382597858D * {size}, 4)), 'coord_max_px', IF(lv IS NULL, 0D, round({size} / 2 * sqrt(2D), 4)))", "struct<coord_mean_px:double,coord_max_px:double>")
