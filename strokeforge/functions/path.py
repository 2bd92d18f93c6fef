"""Path grammar and geometry of one element, as expressions over arrays of commands.

A command is STRUCT<c, p, sx, sy, ex, ey>: letter (M L H V C Q A Z), absolute parameters, start
and end point.
"""

from __future__ import annotations

import math

from . import ids
from .sqlgen import doubles, let, lit, scan, trimmed

COMMANDS = "array<struct<c:string,p:array<double>,sx:double,sy:double,ex:double,ey:double>>"
RAW = "array<struct<c:string,p:array<double>>>"
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
#: Fixed values of the format: parameters of each command, and the arm of a quarter of a circle.
ARITY = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
KAPPA = 0.5522847498
#: allclose() of numpy: what a diagonal and another entry may differ from the identity's.
DIAGONAL, OFF = 1e-9 + 1e-5, 1e-9


def lexed(d: str) -> str:
    """Letters and their numbers. Flags of arcs may be glued to what follows them."""
    sep = r"[\s,]*"
    arc = sep.join([f"({NUMBER})"] * 3 + ["([01])"] * 2 + [f"({NUMBER})"] * 2)
    groups = ", ".join(f"g{i}[k]" for i in range(1, 8))
    arcs = let({f"g{i}": f"regexp_extract_all(t, {lit(arc)}, {i})" for i in range(1, 8)}, f"flatten(transform(IF(size(g1) = 0, cast(array() AS ARRAY<INT>), sequence(0, size(g1) - 1)), k -> array({groups})))", "array<string>")
    plain = f"regexp_extract_all(t, {lit('(' + NUMBER + ')')}, 1)"
    one = f"named_struct('c', substr(t, 1, 1), 'n', {doubles(f"IF(lower(substr(t, 1, 1)) = 'a', {arcs}, {plain})")})"
    return f"transform(regexp_extract_all({d}, '([MmLlHhVvCcSsQqTtAaZz][^MmLlHhVvCcSsQqTtAaZz]*)', 1), t -> {one})"


def chunked(lex: str) -> str:
    """One command per full set of parameters; pairs after a first move are lines; a rest is dropped."""
    arity = "CASE upper(t.c) " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in ARITY.items()) + " END"
    letter = "CASE WHEN k > 0 AND t.c = 'M' THEN 'L' WHEN k > 0 AND t.c = 'm' THEN 'l' ELSE t.c END"
    many = f"transform(sequence(0, cast(floor(size(t.n) / a) AS INT) - 1), k -> named_struct('c', {letter}, 'p', slice(t.n, k * a + 1, a)))"
    none = f"cast(array() AS {RAW})"
    one = let({"a": arity}, f"IF(a = 0, array(named_struct('c', t.c, 'p', cast(array() AS ARRAY<DOUBLE>))), IF(size(t.n) < a, {none}, {many}))", RAW)
    return f"flatten(transform({lex}, t -> {one}))"


def resolved(chunks: str) -> str:
    """Absolute commands. S and T become C and Q; their reflected point is that of the last curve, of either kind."""
    state = "struct<x:double,y:double,mx:double,my:double,kx:double,ky:double>"

    def step(s: str) -> str:
        rx, ry = f"IF({s}.kx IS NULL, {s}.x, 2 * {s}.x - {s}.kx)", f"IF({s}.ky IS NULL, {s}.y, 2 * {s}.y - {s}.ky)"
        pairs = lambda n: ", ".join(f"ox + t.p[{i}], oy + t.p[{i + 1}]" for i in range(0, n, 2))
        absolute = (
            f"CASE u WHEN 'H' THEN array(ox + t.p[0], {s}.y) WHEN 'V' THEN array({s}.x, oy + t.p[0]) WHEN 'C' THEN array({pairs(6)}) WHEN 'S' THEN array({rx}, {ry}, {pairs(4)}) "
            f"WHEN 'Q' THEN array({pairs(4)}) WHEN 'T' THEN array({rx}, {ry}, {pairs(2)}) WHEN 'A' THEN array(t.p[0], t.p[1], t.p[2], t.p[3], t.p[4], ox + t.p[5], oy + t.p[6]) "
            f"WHEN 'Z' THEN cast(array() AS ARRAY<DOUBLE>) ELSE array({pairs(2)}) END"
        )
        ex, ey = f"IF(u = 'Z', {s}.mx, a[size(a) - 2])", f"IF(u = 'Z', {s}.my, a[size(a) - 1])"
        k = lambda i: f"CASE WHEN u IN ('C', 'S') THEN a[{2 + i}] WHEN u IN ('Q', 'T') THEN a[{i}] END"
        kind = "CASE u WHEN 'S' THEN 'C' WHEN 'T' THEN 'Q' ELSE u END"
        return let(
            {"u": "upper(t.c)", "ox": f"IF(t.c = upper(t.c), 0D, {s}.x)", "oy": f"IF(t.c = upper(t.c), 0D, {s}.y)", "a": absolute, "ex": ex, "ey": ey},
            f"named_struct('st', named_struct('x', ex, 'y', ey, 'mx', IF(u = 'M', ex, {s}.mx), 'my', IF(u = 'M', ey, {s}.my), 'kx', {k(0)}, 'ky', {k(1)}), "
            f"'out', array(named_struct('c', {kind}, 'p', a, 'sx', {s}.x, 'sy', {s}.y, 'ex', ex, 'ey', ey)))",
            f"struct<st:{state},out:{COMMANDS}>",
        )

    start = "named_struct('x', 0D, 'y', 0D, 'mx', 0D, 'my', 0D, 'kx', cast(NULL AS DOUBLE), 'ky', cast(NULL AS DOUBLE))"
    # Absolute commands that end at their last two numbers need no state: each starts where the one before it ends.
    at = lambda k, n: f"0D + {k}.p[size({k}.p) - {n}]"
    before = lambda n: f"IF(i = 0, 0D, {at('cs[i - 1]', n)})"
    plain = f"transform(cs, (t, i) -> named_struct('c', t.c, 'p', transform(t.p, v -> 0D + v), 'sx', {before(2)}, 'sy', {before(1)}, 'ex', {at('t', 2)}, 'ey', {at('t', 1)}))"
    return let({"cs": chunks}, f"IF(forall(cs, t -> t.c IN ('M', 'L', 'C', 'Q')), {plain}, {scan('cs', 't', start, state, COMMANDS[6:-1], step)})", COMMANDS)


def parsed(d: str) -> str:
    return resolved(chunked(lexed(d)))


def cmd(c: str, p: list[str], sx: str, sy: str, ex: str, ey: str) -> str:
    params = f"array({', '.join(p)})" if p else "cast(array() AS ARRAY<DOUBLE>)"
    return f"named_struct('c', '{c}', 'p', {params}, 'sx', {sx}, 'sy', {sy}, 'ex', {ex}, 'ey', {ey})"


def _chain(points: list[tuple[str, list[str]]], start: tuple[str, str], close: bool = True) -> str:
    """Commands (letter, parameters) one after another from start; Z goes back to it."""
    out, (x, y) = [cmd("M", list(start), *start, *start)], start
    for c, p in points:
        ex, ey = p[-2:]
        out.append(cmd(c, p, x, y, ex, ey))
        x, y = ex, ey
    return f"array({', '.join(out + ([cmd('Z', [], x, y, *start)] if close else []))})"


def rect(x: str, y: str, w: str, h: str) -> str:
    return _chain([("L", [f"{x} + {w}", y]), ("L", [f"{x} + {w}", f"{y} + {h}"]), ("L", [x, f"{y} + {h}"])], (x, y))


def rounded_rect(x: str, y: str, w: str, h: str, rx: str, ry: str) -> str:
    a = lambda ex, ey: ("A", ["i", "j", "0D", "0D", "1D", ex, ey])
    sides = [
        ("L", [f"{x} + {w} - i", y]), a(f"{x} + {w}", f"{y} + j"), ("L", [f"{x} + {w}", f"{y} + {h} - j"]), a(f"{x} + {w} - i", f"{y} + {h}"),
        ("L", [f"{x} + i", f"{y} + {h}"]), a(x, f"{y} + {h} - j"), ("L", [x, f"{y} + j"]), a(f"{x} + i", y),
    ]
    return let({"i": f"least({rx}, {w} / 2)", "j": f"least({ry}, {h} / 2)"}, _chain(sides, (f"{x} + i", y)), COMMANDS)


def ellipse(cx: str, cy: str, rx: str, ry: str) -> str:
    """Four cubics from the east point on, by way of growing y."""
    at = lambda i, j: (f"{cx} + {rx} * {i!r}D", f"{cy} + {ry} * {j!r}D")
    turns = [(1, 0), (0, 1), (-1, 0), (0, -1)]
    curves = []
    for (a, b), (c, d) in zip(turns, turns[1:] + turns[:1], strict=True):
        curves.append(("C", [*at(a + KAPPA * c, b + KAPPA * d), *at(c + KAPPA * a, d + KAPPA * b), *at(float(c), float(d))]))
    return _chain(curves, (f"{cx} + {rx}", f"{cy} + 0D * {ry}"))


def polyline(v: str, close: str) -> str:
    """From a flat array of numbers; fewer than four make nothing, an odd last one is dropped."""
    at = lambda i: f"{v}[{i}]"
    line = f"named_struct('c', 'L', 'p', array({at('2 * k')}, {at('2 * k + 1')}), 'sx', {at('2 * k - 2')}, 'sy', {at('2 * k - 1')}, 'ex', {at('2 * k')}, 'ey', {at('2 * k + 1')})"
    last = f"cast(floor(size({v}) / 2) AS INT)"
    lines = f"concat(array({cmd('M', [at(0), at(1)], at(0), at(1), at(0), at(1))}), transform(sequence(1, {last} - 1), k -> {line}))"
    closed = f"IF({close}, array({cmd('Z', [], at(f'2 * {last} - 2'), at(f'2 * {last} - 1'), at(0), at(1))}), cast(array() AS {COMMANDS}))"
    return f"IF(size({v}) < 4, cast(array() AS {COMMANDS}), concat({lines}, {closed}))"


def shape(tag: str, v: str, d: str) -> str:
    """Commands of an element from its tag, its numbers v and its path text d."""
    n = lambda *i: [f"{v}[{k}]" for k in i]
    x1, y1, x2, y2 = n(0, 1, 2, 3)
    line = f"array({cmd('M', [x1, y1], x1, y1, x1, y1)}, {cmd('L', [x2, y2], x1, y1, x2, y2)})"
    return (
        f"CASE {tag} WHEN 'path' THEN {parsed(d)} WHEN 'circle' THEN {ellipse(*n(0, 1, 2, 2))} WHEN 'ellipse' THEN {ellipse(*n(0, 1, 2, 3))} "
        f"WHEN 'rect' THEN IF({v}[4] = 0 AND {v}[5] = 0, {rect(*n(0, 1, 2, 3))}, {rounded_rect(*n(0, 1, 2, 3, 4, 5))}) WHEN 'line' THEN {line} "
        f"WHEN 'polygon' THEN {polyline(v, 'true')} WHEN 'polyline' THEN {polyline(v, 'false')} END"
    )


AFFINE = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
MATRIX = ("a", "b", "c", "d", "e", "f")  # x' = a x + c y + e, y' = b x + d y + f
IDENTITY = "named_struct('a', 1D, 'b', 0D, 'c', 0D, 'd', 1D, 'e', 0D, 'f', 0D)"


def matrix(*v: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', cast({x} AS DOUBLE)" for n, x in zip(MATRIX, v, strict=True)) + ")"


def product(m: str, n: str) -> str:
    """m after n: points go through n first."""
    return matrix(
        f"{m}.a * {n}.a + {m}.c * {n}.b", f"{m}.b * {n}.a + {m}.d * {n}.b", f"{m}.a * {n}.c + {m}.c * {n}.d", f"{m}.b * {n}.c + {m}.d * {n}.d",
        f"{m}.a * {n}.e + {m}.c * {n}.f + {m}.e", f"{m}.b * {n}.e + {m}.d * {n}.f + {m}.f",
    )


def transform_matrix(texts: str, start: str = IDENTITY) -> str:
    """The product of start and the transforms of an array of attribute texts, outermost first."""
    number = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
    call = r"((?:matrix|translate|scale|rotate|skewX|skewY)\s*\([^)]*\))"
    get = lambda i, otherwise: f"coalesce(get(v, {i}), {otherwise})"
    c, s = f"cos(radians({get(0, '0D')}))", f"sin(radians({get(0, '0D')}))"
    turn = let({"co": c, "si": s, "px": "IF(size(v) >= 3, v[1], 0D)", "py": "IF(size(v) >= 3, v[2], 0D)"}, matrix("co", "si", "-si", "co", "px - co * px + si * py", "py - si * px - co * py"), AFFINE)
    one = (
        f"CASE WHEN t LIKE 'matrix%' THEN IF(size(v) >= 6, {matrix(*[f'v[{i}]' for i in range(6)])}, {IDENTITY}) "
        f"WHEN t LIKE 'translate%' THEN {matrix('1D', '0D', '0D', '1D', get(0, '0D'), get(1, '0D'))} WHEN t LIKE 'scale%' THEN {matrix(get(0, '1D'), '0D', '0D', get(1, get(0, '1D')), '0D', '0D')} "
        f"WHEN t LIKE 'rotate%' THEN {turn} WHEN t LIKE 'skewX%' THEN {matrix('1D', '0D', f"tan(radians({get(0, '0D')}))", '1D', '0D', '0D')} "
        f"ELSE {matrix('1D', f"tan(radians({get(0, '0D')}))", '0D', '1D', '0D', '0D')} END"
    )
    calls = f"flatten(transform({texts}, x -> regexp_extract_all(coalesce(x, ''), {lit(call)}, 1)))"
    step = let({"v": doubles(f"regexp_extract_all(substring_index(t, '(', -1), {lit(number)}, 1)"), "n": one}, product("m", "n"), AFFINE)
    return f"aggregate({calls}, {start}, (m, t) -> {step})"


def viewbox_matrix(box: str, canvas: float | str) -> str:
    """Scales a box of four numbers evenly into the canvas, centred; anything else changes nothing."""
    side = ids.number(canvas)
    scaled = let({"k": f"{side} / greatest({box}[2], {box}[3])"}, matrix("k", "0D", "0D", "k", f"({side} - {box}[2] * k) / 2 - {box}[0] * k", f"({side} - {box}[3] * k) / 2 - {box}[1] * k"), AFFINE)
    return f"IF({box} IS NOT NULL AND size({box}) = 4 AND {box}[2] > 0 AND {box}[3] > 0, {scaled}, {IDENTITY})"


def is_identity(m: str) -> str:
    return f"(abs({m}.a - 1) <= {DIAGONAL!r}D AND abs({m}.d - 1) <= {DIAGONAL!r}D AND abs({m}.b) <= {OFF!r}D AND abs({m}.c) <= {OFF!r}D AND abs({m}.e) <= {OFF!r}D AND abs({m}.f) <= {OFF!r}D)"


def applied(cmds: str, m: str) -> str:
    """Commands moved by a matrix. H and V keep their kind; radii of arcs grow with the square root of the area."""
    px = lambda x, y: f"{m}.a * {x} + {m}.c * {y} + {m}.e"
    py = lambda x, y: f"{m}.b * {x} + {m}.d * {y} + {m}.f"
    pairs = f"transform(k.p, (v, i) -> IF(i % 2 = 0, {px('v', 'k.p[i + 1]')}, {py('k.p[i - 1]', 'v')}))"
    arc = f"array(k.p[0] * g, k.p[1] * g, k.p[2], k.p[3], k.p[4], {px('k.p[5]', 'k.p[6]')}, {py('k.p[5]', 'k.p[6]')})"
    one = f"named_struct('c', k.c, 'p', IF(k.c = 'A', {arc}, {pairs}), 'sx', {px('k.sx', 'k.sy')}, 'sy', {py('k.sx', 'k.sy')}, 'ex', {px('k.ex', 'k.ey')}, 'ey', {py('k.ex', 'k.ey')})"
    det = f"abs({m}.a * {m}.d - {m}.c * {m}.b)"
    return f"IF({is_identity(m)}, {cmds}, {let({'g': f'IF({det} > 0, sqrt({det}), 1D)'}, f'transform({cmds}, k -> {one})', COMMANDS)})"


def without_arcs(cmds: str) -> str:
    """Arcs as cubics of a quarter turn at most; one of no radius or no length becomes a line."""
    angle = lambda ux, uy, vx, vy: (
        f"IF(sqrt(({ux})*({ux})+({uy})*({uy})) * sqrt(({vx})*({vx})+({vy})*({vy})) = 0, 0D, "
        f"IF(({ux})*({vy})-({uy})*({vx}) < 0, -1D, 1D) * acos(greatest(-1D, least(1D, (({ux})*({vx})+({uy})*({vy})) / (sqrt(({ux})*({ux})+({uy})*({uy})) * sqrt(({vx})*({vx})+({vy})*({vy}))))))) "
    )
    point = lambda f: (f"(g.co * g.rx * cos({f}) - g.si * g.ry * sin({f}) + g.cx)", f"(g.si * g.rx * cos({f}) + g.co * g.ry * sin({f}) + g.cy)")
    slope = lambda f: (f"(g.co * -g.rx * sin({f}) - g.si * g.ry * cos({f}))", f"(g.si * -g.rx * sin({f}) + g.co * g.ry * cos({f}))")
    (x0, y0), (x1, y1), (dx0, dy0), (dx1, dy1) = point("f0"), point("f1"), slope("f0"), slope("f1")
    cubic = let(
        {"f0": "g.t + i * g.d", "f1": "g.t + (i + 1) * g.d", "ax": f"IF(i = 0, k.sx, {x0})", "ay": f"IF(i = 0, k.sy, {y0})", "bx": x1, "by": y1, "w": "4D / 3 * tan(g.d / 4)"},
        f"named_struct('c', 'C', 'p', array(ax + w * {dx0}, ay + w * {dy0}, bx - w * {dx1}, by - w * {dy1}, bx, by), 'sx', ax, 'sy', ay, 'ex', bx, 'ey', by)",
        COMMANDS[6:-1],
    )
    turn = angle("ux", "uy", "-xp / rx - qx / rx", "-yp / ry - qy / ry")
    curve = let(
        {
            "phi": "radians(pmod(k.p[2], 360D))", "co": "cos(phi)", "si": "sin(phi)", "hx": "(k.sx - k.p[5]) / 2", "hy": "(k.sy - k.p[6]) / 2",
            "xp": "co * hx + si * hy", "yp": "-si * hx + co * hy", "r0": "abs(k.p[0])", "r1": "abs(k.p[1])",
            "lam": "xp * xp / (r0 * r0) + yp * yp / (r1 * r1)", "rx": "IF(lam > 1, r0 * sqrt(lam), r0)", "ry": "IF(lam > 1, r1 * sqrt(lam), r1)",
            "den": "rx * rx * yp * yp + ry * ry * xp * xp", "q0": "IF(den = 0, 0D, sqrt(greatest(0D, (rx * rx * ry * ry - den) / den)))",
            "q": "IF(cast(k.p[3] AS INT) = cast(k.p[4] AS INT), -q0, q0)", "qx": "q * (rx * yp / ry)", "qy": "q * (-ry * xp / rx)",
            "ux": "(xp - qx) / rx", "uy": "(yp - qy) / ry", "turn0": turn,
            "turn": f"CASE WHEN k.p[4] = 0 AND turn0 > 0 THEN turn0 - {2 * math.pi!r}D WHEN k.p[4] <> 0 AND turn0 < 0 THEN turn0 + {2 * math.pi!r}D ELSE turn0 END",
            "n": f"greatest(1, cast(ceil(abs(turn) / {math.pi / 2!r}D) AS INT))",
            "g": f"named_struct('co', co, 'si', si, 'rx', rx, 'ry', ry, 'cx', co * qx - si * qy + (k.sx + k.p[5]) / 2, 'cy', si * qx + co * qy + (k.sy + k.p[6]) / 2, 't', {angle('1D', '0D', 'ux', 'uy')}, 'd', turn / n)",
        },
        f"transform(sequence(0, n - 1), i -> {cubic})",
        COMMANDS,
    )
    flat = "k.p[0] = 0 OR k.p[1] = 0 OR (k.sx = k.p[5] AND k.sy = k.p[6])"
    line = "array(named_struct('c', 'L', 'p', array(k.p[5], k.p[6]), 'sx', k.sx, 'sy', k.sy, 'ex', k.p[5], 'ey', k.p[6]))"
    return f"flatten(transform({cmds}, k -> CASE WHEN k.c <> 'A' THEN array(k) WHEN {flat} THEN {line} ELSE {curve} END))"


def points(k: str = "k") -> str:
    """The points of a command that are encoded: an arc's radii count as one."""
    pt = lambda i, j: f"named_struct('x', {k}.p[{i}], 'y', {k}.p[{j}])"
    return (
        f"CASE {k}.c WHEN 'Z' THEN cast(array() AS ARRAY<STRUCT<x:DOUBLE,y:DOUBLE>>) WHEN 'C' THEN array({pt(0, 1)}, {pt(2, 3)}, {pt(4, 5)}) WHEN 'Q' THEN array({pt(0, 1)}, {pt(2, 3)}) "
        f"WHEN 'A' THEN array({pt(0, 1)}, {pt(5, 6)}) ELSE array({pt(0, 1)}) END"
    )


def all_points(cmds: str) -> str:
    return f"flatten(transform({cmds}, k -> {points()}))"


def path_text(cmds: str) -> str:
    """Commands as a path's d at three decimals; H and V as L."""
    n = lambda i: trimmed(f"k.p[{i}]", 3)
    j = lambda c, *i: "concat_ws(' ', " + ", ".join([f"'{c}'", *map(n, i)]) + ")"
    arc = f"concat_ws(' ', 'A', {n(0)}, {n(1)}, {n(2)}, cast(k.p[3] AS INT), cast(k.p[4] AS INT), {n(5)}, {n(6)})"
    one = f"CASE k.c WHEN 'M' THEN {j('M', 0, 1)} WHEN 'C' THEN {j('C', 0, 1, 2, 3, 4, 5)} WHEN 'Q' THEN {j('Q', 0, 1, 2, 3)} WHEN 'A' THEN {arc} WHEN 'Z' THEN 'Z' ELSE {j('L', 0, 1)} END"
    return f"array_join(transform({cmds}, k -> {one}), ' ')"


def bbox(cmds: str) -> str:
    """Of start and end points only, as named_struct(x0, y0, x1, y1)."""
    side = lambda f, a, b: f"{f}(transform({cmds}, k -> {'least' if f == 'array_min' else 'greatest'}(k.{a}, k.{b})))"
    return f"named_struct('x0', {side('array_min', 'sx', 'ex')}, 'y0', {side('array_min', 'sy', 'ey')}, 'x1', {side('array_max', 'sx', 'ex')}, 'y1', {side('array_max', 'sy', 'ey')})"


def is_drawable(d: str) -> str:
    """Whether a path text begins with a move and draws something."""
    return f"(coalesce(trim({d}) RLIKE '^[Mm]', false) AND exists({chunked(lexed(d))}, k -> upper(k.c) NOT IN ('M', 'Z')))"
