"""Tokens of commands, elements and documents."""

from __future__ import annotations

from . import ids, path
from .curves import Thresholds, analysed, curvature_bin


def coords(k: str = "k", level: int | str = ids.LEVEL, canvas: float | str = ids.CANVAS) -> str:
    """Coordinate ids of a command's points."""
    return f"transform({path.points(k)}, q -> {ids.coord_id('q.x', 'q.y', level, canvas)})"


def letter_id(k: str = "k") -> str:
    return f"CASE {k}.c " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in ids.LETTERS.items()) + " END"


def lean(cmds: str, level: int | str = ids.LEVEL, canvas: float | str = ids.CANVAS) -> str:
    """The body of an element without markers."""
    return f"flatten(transform({cmds}, k -> concat(array({letter_id()}), {coords("k", level, canvas)})))"


def full(cmds: str, th: Thresholds = Thresholds(), level: int | str = ids.LEVEL, canvas: float | str = ids.CANVAS) -> str:
    """The body of an element with continuity and curvature markers, in this order after the coordinates."""
    none = "cast(array() AS ARRAY<INT>)"
    markers = f"concat(IF(u.level IS NULL, {none}, array(31 + u.level)), IF(u.g IS NULL OR u.g.straight, {none}, array({ids.CURVATURE} + {curvature_bin('u.g.kmax')})))"
    return f"flatten(transform({analysed(cmds, th, measured=False)}, u -> concat(array({letter_id('u.k')}), {coords('u.k', level, canvas)}, {markers})))"


def bracketed(bodies: str) -> str:
    """A stream of element bodies: BOS, bodies parted by SEP, EOS. Empty bodies are left out first."""
    kept = f"filter({bodies}, b -> size(b) > 0)"
    joined = f"flatten(transform({kept}, (b, i) -> IF(i > 0, concat(array(3), b), b)))"
    return f"concat(array(1), coalesce({joined}, cast(array() AS ARRAY<INT>)), array(2))"


def lean_of(tokens: str) -> str:
    """A stream without its markers."""
    return f"filter({tokens}, t -> NOT ((t >= 30 AND t < 34) OR (t >= 40 AND t < 56)))"


def symbols(tokens: str, merge_base: int | str = ids.VOCAB) -> str:
    return f"transform({tokens}, t -> {ids.symbol('t', merge_base)})"


def bad_id(tokens: str, upper: int | str = ids.VOCAB) -> str:
    """The first id out of range, or null."""
    return f"get(filter({tokens}, t -> t < 0 OR t >= {upper}), 0)"


def class_ratio(n_tokens: str, n_commands: str, text_length: str = "0") -> str:
    """Tokens per source character, a command counting as 20 where there is no source."""
    return f"({n_tokens} / cast(greatest(IF({text_length} > 0, {text_length}, {n_commands} * 20), 1) AS DOUBLE))"


def baseline_count(bodies: str) -> str:
    """How many tokens element bodies take one after another: brackets, separators and all."""
    return f"(2 + aggregate({bodies}, 0, (n, b) -> n + size(b)) + greatest(size({bodies}) - 1, 0))"


def adaptive(cmds: str, nodes: str) -> str:
    """The lean body with each point on the level of its leaf in an adaptive grid."""
    from ..operators.quadtree import leaf_level

    at = f"transform({path.points()}, q -> {ids.coord_id_at('q.x', 'q.y', leaf_level('q.x', 'q.y', nodes))})"
    return f"flatten(transform({cmds}, k -> concat(array({letter_id()}), {at})))"
