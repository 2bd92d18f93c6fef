"""The token id space in closed form, and the coordinate, scalar and count codecs.

Coordinates of level l (0 to 6) are ids BASE + (4**l - 1) / 3 + qy * 2**l + qx; everything
below BASE is a fixed symbol. All functions take and return SQL text; a canvas and a deepest level
may be numbers or SQL text themselves, so that each row can have its own.
"""

from __future__ import annotations

CANVAS, LEVEL, BASE = 300.0, 6, 100
VOCAB = BASE + (4 ** (LEVEL + 1) - 1) // 3
#: The version of the encoding is the number after the last dash; who wrote a stream doesn't matter.
FORMAT = "1.0.0"
TOKENIZER_VERSION, VOCAB_ID = f"strokeforge-{FORMAT}", "geom-5561-v1"
EDGE = 1e-6  # a clamped coordinate lies this far inside the canvas
SCALARS = 4 ** LEVEL

# The symbol table of the format.
SPECIAL = {0: "PAD", 1: "BOS", 2: "EOS", 3: "SEP", 4: "UNK"}
COMMAND = {10: "MOVE", 11: "LINE", 12: "HLINE", 13: "VLINE", 14: "CUBIC", 15: "QUADRATIC", 16: "ARC", 17: "CLOSE"}
COMPOSITE = {20: "CIRCLE", 21: "ELLIPSE", 22: "RECT", 23: "ROUND_RECT"}
CONTINUITY = {30: "DISC", 31: "G0", 32: "G1", 33: "G2"}
CURVATURE, CURVATURE_BINS = 40, 16
SPATIAL = {
    60: "ALIGN_CENTER_H", 61: "ALIGN_CENTER_V", 62: "SYM_REFLECT_X", 63: "SYM_REFLECT_Y", 64: "EQUAL_SPACE_H", 65: "EQUAL_SPACE_V",
    66: "EQUAL_SIZE", 67: "REPEAT_2", 68: "REPEAT_3", 69: "REPEAT_4", 70: "REPEAT_N",
}
SYMBOLS = SPECIAL | COMMAND | COMPOSITE | CONTINUITY | SPATIAL
#: Path letter -> command id.
LETTERS = {"M": 10, "L": 11, "H": 12, "V": 13, "C": 14, "Q": 15, "A": 16, "Z": 17}


def level_base(level: int) -> int:
    return BASE + (4**level - 1) // 3


def cell(level: int = LEVEL, canvas: float = CANVAS) -> float:
    return canvas / 2**level


def number(v: float | str) -> str:
    """SQL of a double that is given as a number or as SQL."""
    return v if isinstance(v, str) else f"{float(v)!r}D"


def side(level: int | str) -> str:
    """SQL: cells in a row of a level."""
    return f"shiftleft(1, {level})" if isinstance(level, str) else f"{2**level}"


def first_id(level: int | str) -> str:
    """SQL: the first coordinate id of a level."""
    return f"({BASE} + cast((shiftleft(1, 2 * {level}) - 1) div 3 AS INT))" if isinstance(level, str) else f"{level_base(level)}"


def codes(level: int | str) -> str:
    """SQL: how many values a scalar or count has."""
    return f"shiftleft(1, 2 * {level})" if isinstance(level, str) else f"{4**level}"


def vocab_size(level: int | str = LEVEL) -> str:
    """SQL: how many ids there are down to a level."""
    return f"({first_id(level)} + {codes(level)})"


def cell_size(level: int | str, canvas: float | str) -> str:
    """SQL: the side of a level's cell."""
    return f"({number(canvas)} / {side(level)})" if isinstance(level, str) or isinstance(canvas, str) else f"{cell(level, canvas)!r}D"


def clamped(v: str, canvas: float | str = CANVAS) -> str:
    """Into [0, canvas - EDGE]; NaN counts as 0."""
    top = f"({canvas} - {EDGE!r}D)" if isinstance(canvas, str) else f"{canvas - EDGE!r}D"
    return f"greatest(0D, least(nanvl({v}, 0D), {top}))"


def quantised(v: str, level: int | str = LEVEL, canvas: float | str = CANVAS) -> str:
    return f"cast(least(floor({clamped(v, canvas)} / {cell_size(level, canvas)}), {side(level)} - 1) AS INT)"


def coord_id(x: str, y: str, level: int | str = LEVEL, canvas: float | str = CANVAS) -> str:
    return f"({first_id(level)} + {quantised(y, level, canvas)} * {side(level)} + {quantised(x, level, canvas)})"


def is_coord(t: str) -> str:
    return f"({t} >= {BASE} AND {t} < {VOCAB})"


def level_of(t: str) -> str:
    """Level of a coordinate id; null for other ids."""
    return "CASE " + f"WHEN {t} < {BASE} OR {t} >= {VOCAB} THEN NULL " + " ".join(f"WHEN {t} < {level_base(k + 1)} THEN {k}" for k in range(LEVEL + 1)) + " END"


def _by_level(t: str, f) -> str:
    return "CASE " + f"WHEN {t} < {BASE} OR {t} >= {VOCAB} THEN NULL " + " ".join(f"WHEN {t} < {level_base(k + 1)} THEN {f(k)}" for k in range(LEVEL + 1)) + " END"


def qx(t: str) -> str:
    return _by_level(t, lambda k: f"({t} - {level_base(k)}) % {2**k}")


def qy(t: str) -> str:
    return _by_level(t, lambda k: f"cast(floor(({t} - {level_base(k)}) / {2**k}) AS INT)")


def x_of(t: str, canvas: float | str = CANVAS) -> str:
    """The centre of a coordinate id's cell."""
    return _by_level(t, lambda k: f"(({t} - {level_base(k)}) % {2**k} + 0.5D) * {cell_size(k, canvas)}")


def y_of(t: str, canvas: float | str = CANVAS) -> str:
    return _by_level(t, lambda k: f"(floor(({t} - {level_base(k)}) / {2**k}) + 0.5D) * {cell_size(k, canvas)}")


def packed(code: str, level: int | str = LEVEL) -> str:
    """The deepest coordinate id that stands for a code, 0..4095 on level 6: qx is its high part."""
    n = side(level)
    return f"({first_id(level)} + ({code}) % {n} * {n} + cast(floor(({code}) / {n}) AS INT))"


def code_of(t: str, level: int | str = LEVEL) -> str:
    n, first = side(level), first_id(level)
    return f"(({t} - {first}) % {n} * {n} + cast(floor(({t} - {first}) / {n}) AS INT))"


def scalar_code(v: str, canvas: float | str = CANVAS, level: int | str = LEVEL) -> str:
    """Fixed point, ties to even; what isn't finite counts as 0."""
    finite = f"IF({v} IS NULL OR isnan({v}) OR abs({v}) = double('infinity'), 0D, {v})"
    return f"cast(rint(greatest(0D, least({finite}, {number(canvas)})) / {number(canvas)} * ({codes(level)} - 1)) AS INT)"


def scalar_id(v: str, canvas: float | str = CANVAS, level: int | str = LEVEL) -> str:
    return packed(scalar_code(v, canvas, level), level)


def scalar_of(t: str, canvas: float | str = CANVAS, level: int | str = LEVEL) -> str:
    return f"({code_of(t, level)} / cast({codes(level)} - 1 AS DOUBLE) * {number(canvas)})"


def count_id(n: str, level: int | str = LEVEL) -> str:
    return packed(f"greatest(0, least(cast({n} AS INT), {codes(level)} - 1))", level)


def symbol_id(name: str) -> str:
    """The id of a fixed symbol's name; null for other names."""
    return f"CASE {name} " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in SYMBOLS.items()) + " END"


def curvature_id(bin: str) -> str:
    """The id of a curvature bin, which is taken into the range there is."""
    return f"cast({CURVATURE} + greatest(0, least({bin}, {CURVATURE_BINS - 1})) AS INT)"


def bound(level: int | str = LEVEL, canvas: float | str = CANVAS) -> str:
    """The largest distance of a point from its cell's centre."""
    return f"({number(canvas)} / power(2D, {level}) / 2 * sqrt(2D))"


def scalar_bound(canvas: float = CANVAS) -> float:
    return canvas / (SCALARS - 1) / 2


def symbol(t: str, merge_base: int | str = VOCAB) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in SYMBOLS.items())
    curve = f"WHEN {t} >= {CURVATURE} AND {t} < {CURVATURE + CURVATURE_BINS} THEN concat('CURV@', {t} - {CURVATURE})"
    coord = f"WHEN {is_coord(t)} THEN concat('C', {level_of(t)}, ':', {qx(t)}, ',', {qy(t)})"
    return f"CASE {t} {cases} ELSE CASE WHEN {t} >= {merge_base} THEN concat('MERGE@', {t}) {curve} {coord} ELSE concat('?', {t}) END END"


def kind(t: str) -> str:
    """The type name of an id: special, command, composite, continuity, curvature, spatial, coord or unknown."""
    ranges = [(0, 5, "special"), (10, 18, "command"), (20, 24, "composite"), (30, 34, "continuity"), (40, 56, "curvature"), (60, 71, "spatial"), (BASE, VOCAB, "coord")]
    return "CASE " + " ".join(f"WHEN {t} >= {a} AND {t} < {b} THEN '{k}'" for a, b, k in ranges) + " ELSE 'unknown' END"


def embedding_class(t: str) -> str:
    """The seven classes of ids that a model's type embedding tells apart."""
    return f"CASE WHEN {t} < 10 THEN 0 WHEN {t} < 20 THEN 1 WHEN {t} < 30 THEN 2 WHEN {t} >= 30 AND {t} < 34 THEN 3 WHEN {t} >= 40 AND {t} < 56 THEN 4 WHEN {t} >= 60 AND {t} < 80 THEN 5 ELSE 6 END"


def coord_id_at(x: str, y: str, level: str, canvas: float = CANVAS) -> str:
    """The coordinate id on a level that is itself an expression."""
    return "CASE " + level + " " + " ".join(f"WHEN {k} THEN {coord_id(x, y, k, canvas)}" for k in range(LEVEL + 1)) + " END"


def cell_number(t: str) -> str:
    """The number of a coordinate id among all coordinates: levels one after another, without the base."""
    return f"IF({is_coord(t)}, {t} - {BASE}, NULL)"
