"""Differential geometry of segments, and the continuity of their junctions.

A segment is STRUCT<kmax, kmean, k0, k1, t0, t1, len, straight>: greatest and mean absolute
curvature, curvature and tangent angle at both ends, length, straightness.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from .sqlgen import let, scan

SAMPLES = 30
STRAIGHT = 1e-4
SEGMENT = "struct<kmax:double,kmean:double,k0:double,k1:double,t0:double,t1:double,len:double,straight:boolean>"


@dataclass(frozen=True)
class Thresholds:
    """What counts as continuous: px, radians, 1/px; or the relative test of curvature."""

    g0: float = 0.5
    g1: float = 0.1
    g2: float = 0.05
    relative: bool = False
    tolerance: float = 0.2
    epsilon: float = 1e-6


def d1(axis: str, t: str) -> str:
    a = axis
    return f"(3 * (1 - {t}) * (1 - {t}) * ({a}1 - {a}0) + 6 * (1 - {t}) * {t} * ({a}2 - {a}1) + 3 * {t} * {t} * ({a}3 - {a}2))"


def d2(axis: str, t: str) -> str:
    a = axis
    return f"(6 * (1 - {t}) * ({a}2 - 2 * {a}1 + {a}0) + 6 * {t} * ({a}3 - 2 * {a}2 + {a}1))"


def at(axis: str, t: str) -> str:
    a = axis
    return f"((1 - {t}) * (1 - {t}) * (1 - {t}) * {a}0 + 3 * (1 - {t}) * (1 - {t}) * {t} * {a}1 + 3 * (1 - {t}) * {t} * {t} * {a}2 + {t} * {t} * {t} * {a}3)"


def curvature(t: str) -> str:
    """Signed curvature at t of the cubic whose points are x0..x3, y0..y3; 0 where it stands still."""
    body = "IF(sp * sp * sp < 1e-12, 0D, (ux * wy - uy * wx) / (sp * sp * sp))"
    return let({"ux": d1("x", t), "uy": d1("y", t), "wx": d2("x", t), "wy": d2("y", t), "sp": "sqrt(ux * ux + uy * uy)"}, body)


def angle(t: str) -> str:
    return let({"ux": d1("x", t), "uy": d1("y", t)}, "IF(sqrt(ux * ux + uy * uy) < 1e-12, 0D, atan2(uy, ux))")


def controls(k: str = "k") -> dict[str, str]:
    """Bindings x0..y3: the points of a C, or of a Q raised to a cubic."""
    out = {"x0": f"{k}.sx", "y0": f"{k}.sy", "x3": f"{k}.ex", "y3": f"{k}.ey"}
    for axis, i in (("x", 0), ("y", 1)):
        out[f"{axis}1"] = f"IF({k}.c = 'C', {k}.p[{i}], {axis}0 + (2D / 3) * ({k}.p[{i}] - {axis}0))"
        out[f"{axis}2"] = f"IF({k}.c = 'C', {k}.p[{2 + i}], {axis}3 + (2D / 3) * ({k}.p[{i}] - {axis}3))"
    return out


def length(samples: int = 2 * SAMPLES) -> str:
    """Length of the polyline through samples points of the cubic x0..y3."""
    t = f"(i / {samples - 1}D)"
    pts = f"transform(sequence(0, {samples - 1}), i -> named_struct('x', {at('x', t)}, 'y', {at('y', t)}))"
    return let({"pts": pts}, f"aggregate(sequence(1, {samples - 1}), 0D, (a, i) -> a + sqrt(power(pts[i].x - pts[i - 1].x, 2) + power(pts[i].y - pts[i - 1].y, 2)))")


def segment(k: str = "k", measured: bool = True) -> str:
    """The segment of a command; null for M and Z. Not measured: without length and mean, which cost as much as the rest."""
    s = lambda kmax, kmean, k0, k1, t0, t1, ln, straight: f"named_struct('kmax', {kmax}, 'kmean', {kmean}, 'k0', {k0}, 'k1', {k1}, 't0', {t0}, 't1', {t1}, 'len', {ln}, 'straight', {straight})"
    ks = f"transform(transform(sequence(0, {SAMPLES - 1}), i -> i / {SAMPLES - 1}D), tt -> {curvature('tt')})"
    top = "array_max(transform(ks, z -> abs(z)))"
    mean = f"aggregate(ks, 0D, (a, z) -> a + abs(z)) / {SAMPLES}" if measured else "cast(NULL AS DOUBLE)"
    curve = let(controls(k) | {"ks": ks, "top": top}, s("top", mean, "ks[0]", f"ks[{SAMPLES - 1}]", angle("0D"), angle("1D"), length() if measured else "cast(NULL AS DOUBLE)", f"{k}.c = 'C' AND top < {STRAIGHT!r}D"), SEGMENT)
    chord = {"ch": f"sqrt(power({k}.ex - {k}.sx, 2) + power({k}.ey - {k}.sy, 2))", "th": f"IF(ch < 1e-12, 0D, atan2({k}.ey - {k}.sy, {k}.ex - {k}.sx))"}
    line = let(chord, s("0D", "0D", "0D", "0D", "th", "th", "ch", "true"), SEGMENT)
    arc = let(chord | {"kap": f"IF({k}.p[0] < 1e-6 OR {k}.p[1] < 1e-6, 0D, 2D / ({k}.p[0] + {k}.p[1]))"}, s("kap", "kap", "kap", "kap", "th", "th", "ch * 1.2D", "false"), SEGMENT)
    return f"CASE WHEN {k}.c IN ('C', 'Q') THEN {curve} WHEN {k}.c IN ('L', 'H', 'V') THEN {line} WHEN {k}.c = 'A' THEN {arc} END"


def curvature_bin(kmax: str, bins: int = 16) -> str:
    return f"IF({kmax} < 1e-6, 0, least(cast(floor(ln(1 + {kmax} * 100) / 5 * {bins}) AS INT), {bins - 1}))"


def complexity(seg: str) -> str:
    return f"({seg}.kmax * {seg}.len)"


def continuity(px: str, py: str, pt: str, pk: str, x: str, y: str, t: str, k: str, th: Thresholds = Thresholds()) -> str:
    """Level of the junction of a segment ending at px, py with angle pt and curvature pk and one that starts with x, y, t, k: -1, 0, 1, 2."""
    turn = f"least(abs({pt} - {t}), {2 * math.pi!r}D - abs({pt} - {t}))"
    off = f"abs({pk} - {k})"
    bent = f"{off} / greatest(abs({pk}), abs({k}), {th.epsilon!r}D) > {th.tolerance!r}D" if th.relative else f"{off} > {th.g2!r}D"
    return f"CASE WHEN sqrt(power({px} - {x}, 2) + power({py} - {y}, 2)) > {th.g0!r}D THEN -1 WHEN {turn} > {th.g1!r}D THEN 0 WHEN {bent} THEN 1 ELSE 2 END"


def analysed(cmds: str, th: Thresholds = Thresholds(), measured: bool = True) -> str:
    """Array of STRUCT<k: command, g: segment, level INT>: level is that of the junction with the drawn command before, null without one.

    A move ends the memory of what was drawn before; a close doesn't.
    """
    kind = "struct<c:string,p:array<double>,sx:double,sy:double,ex:double,ey:double>"
    pair = f"struct<k:{kind},g:{SEGMENT}>"

    def step(s: str) -> str:
        level = f"IF({s}.last IS NULL OR u.g IS NULL, cast(NULL AS INT), {continuity(f'{s}.last.k.ex', f'{s}.last.k.ey', f'{s}.last.g.t1', f'{s}.last.g.k1', 'u.k.sx', 'u.k.sy', 'u.g.t0', 'u.g.k0', th)})"
        last = f"CASE WHEN u.k.c = 'M' THEN cast(NULL AS {pair}) WHEN u.g IS NULL THEN {s}.last ELSE u END"
        return f"named_struct('st', named_struct('last', {last}), 'out', array(named_struct('k', u.k, 'g', u.g, 'level', {level})))"

    both = f"transform({cmds}, k -> named_struct('k', k, 'g', {segment('k', measured)}))"
    return scan(both, "u", f"named_struct('last', cast(NULL AS {pair}))", f"struct<last:{pair}>", f"struct<k:{kind},g:{SEGMENT},level:int>", step)


def profile(samples: int = 20) -> str:
    """Signed curvatures at evenly spaced places of the cubic x0..y3."""
    return f"transform(sequence(0, {samples - 1}), i -> {curvature(f'(i / {samples - 1}D)')})"


def same_direction(ax: str, ay: str, bx: str, by: str, limit: float = Thresholds.g1) -> str:
    """Whether two tangents differ by less than limit; tangents of no length go with any."""
    n = lambda x, y: f"sqrt({x} * {x} + {y} * {y})"
    turn = f"acos(greatest(-1D, least(1D, ({ax} * {bx} + {ay} * {by}) / ({n(ax, ay)} * {n(bx, by)}))))"
    return f"IF({n(ax, ay)} < 1e-12 OR {n(bx, by)} < 1e-12, true, {turn} < {limit!r}D)"


def same_curvature(a: str, b: str, limit: float = Thresholds.g2) -> str:
    return f"(abs({a} - {b}) < {limit!r}D)"
