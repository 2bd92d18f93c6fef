"""Queries over synthetic drawings of every part, reports on them, and mixed layouts of every supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grammar, relations, shapes
from ..operators import codec, evaluation, mldata
from . import fixtures as fx
from .core import TEXT, d_id, d_scalar
from .registry import query


# Synthetic drawings.
def _u(*k: object) -> str:
    key = " || ':' || ".join(["'draw:42'", "id", *map(str, k)])
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE)"


def _at(*k: object) -> str:
    return d_id(f"({_u(*k[:-1])} * 299)", f"({_u(*k[:-2], k[-1])} * 299)")


def _sc(k: int) -> str:
    return d_scalar(f"({_u(k)} * 100 + 5)")


def _kinds() -> str:
    edge, out = 0.0, []
    for name, w in mldata.KINDS:
        edge += w
        out.append(f"WHEN {_u(0)} < {edge!r}::DOUBLE THEN '{name}'")
    return f"CASE {' '.join(out)} ELSE 'multi' END"


_LINE, _CURVE = f"'11,' || {_at('i', 0, 1)}", f"'14,' || {_at('i', 0, 1)} || ',' || {_at('i', 2, 3)} || ',' || {_at('i', 4, 5)}"
_PATH = lambda one: f"'10,' || {_at(1, 2)} || ',' || array_to_string(list_transform(range(1, 4 + floor({_u(5)} * 5)::BIGINT), lambda i: {one}), ',')"
_CIRCLE, _RECT = f"'20,' || {_at(1, 2)} || ',' || {_sc(3)}", f"'22,' || {_at(1, 2)} || ',' || {_sc(3)} || ',' || {_sc(4)}"
_BODY = (
    f"CASE category WHEN 'circle' THEN {_CIRCLE} WHEN 'rect' THEN {_RECT} WHEN 'ellipse' THEN '21,' || {_at(1, 2)} || ',' || {_sc(3)} || ',' || {_sc(4)} WHEN 'line_path' THEN {_PATH(_LINE)} WHEN 'curve_path' THEN {_PATH(_CURVE)} "
    f"WHEN 'mixed_path' THEN {_PATH(f'CASE WHEN i % 2 = 0 THEN {_LINE} ELSE {_CURVE} END')} ELSE {_CIRCLE} || ',3,' || {_RECT} END"
)
_SYNTHETIC = f"kn AS (SELECT p_partkey AS id, {{}} AS category FROM part), sy AS (SELECT id, category, '1,' || {_BODY} || ',2' AS t FROM kn)".format(_kinds())


def synthetic(spark, d) -> DataFrame:
    return mldata.synthetic_for(fx.spread(fx.table(spark, d, "part")), "p_partkey").withColumn("is_valid", F.expr(f"({grammar.validated('token_ids')}).valid"))


@query("m1_synthetic", f"WITH {_SYNTHETIC} SELECT id AS sample_id, category, t, true AS valid FROM sy")
def m1(spark, d):
    """A synthetic drawing for every part."""
    return synthetic(spark, d).select("sample_id", "category", F.expr(TEXT).alias("t"), F.col("is_valid").alias("valid"))


_CATEGORY = "CASE category WHEN 'line_path' THEN 'path' WHEN 'curve_path' THEN 'curve' WHEN 'mixed_path' THEN 'curve' WHEN 'multi' THEN 'circle' ELSE category END"
_FIGURES = (
    "g AS (SELECT t, category, [x::INT FOR x IN string_split(t, ',')] AS a FROM sy), "
    "h AS (SELECT *, len(a) AS n, len(list_distinct(a)) AS u, list_filter(a, lambda x: x >= 100) AS c FROM g)"
)


@query(
    "e16_report",
    f"WITH {_SYNTHETIC}, {_FIGURES}, k AS (SELECT {_CATEGORY} AS category, count(*) AS n FROM sy GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS r, sum(n) OVER () AS s FROM k) "
    "SELECT 0 AS line, printf('%-16s %d', 'samples', count(*)) AS text FROM h UNION ALL SELECT 1, printf('%-16s %.1f%%', 'valid documents', 100::DOUBLE) FROM h HAVING count(*) > 0 "
    "UNION ALL SELECT 4, printf('%-16s %.3f', 'diversity', round((count(DISTINCT t) / count(*)::DOUBLE + avg(u / n::DOUBLE)) / 2, 6)) FROM h UNION ALL SELECT 5, printf('%-16s %.1f', 'mean length', round(avg(n), 6)) FROM h "
    "UNION ALL SELECT 6, printf('%-16s %d to %d', 'lengths', min(n), max(n)) FROM h UNION ALL SELECT (6 + r)::INT, printf('  %-14s %d (%.1f%%)', category, n, 100 * n / s::DOUBLE) FROM o",
)
def e16_report(spark, d):
    """The report on every part's synthetic drawing, but for the lines of structure and geometry, which e15 checks."""
    return evaluation.report(synthetic(spark, d)).filter("line NOT IN (2, 3)")


# Layouts that mix kinds, sizes, rows and columns.
_PLACE = {"n": "2 + s_suppkey % 5", "x": "30 + 40 * ((s_suppkey + i * (s_suppkey % 3)) % 6)", "y": "30 + 40 * ((s_suppkey * 2 + i * (1 + s_suppkey % 2)) % 6)", "r": "8 + 7 * ((s_suppkey + i) % (1 + s_suppkey % 4 // 2))"}


def layouts(spark, d) -> DataFrame:
    """doc_id, svg: two to six circles and squares of one or two sizes for each supplier, in a row, a column or askew."""
    s = fx.spread(fx.table(spark, d, "supplier")).select("s_suppkey")
    x, y, r = ("(" + _PLACE[k].replace("//", "div") + ")" for k in "xyr")
    shape = f"IF((s_suppkey + i) % 3 = 0, concat('<rect x=\"', {x} - {r}, '\" y=\"', {y} - {r}, '\" width=\"', 2 * ({r}), '\" height=\"', 2 * ({r}), '\"/>'), concat('<circle cx=\"', {x}, '\" cy=\"', {y}, '\" r=\"', {r}, '\"/>'))"
    return s.select(F.col("s_suppkey").cast("long").alias("doc_id"), F.expr(f"concat('<svg>', array_join(transform(sequence(0, cast({_PLACE['n']} - 1 AS INT)), i -> {shape}), ''), '</svg>')").alias("svg"))


# Places are multiples of 20 and sizes differ by 14, so what lies within a tolerance is equal.
_LAID = f"e AS (SELECT s_suppkey::BIGINT AS doc_id, i, {_PLACE['x']} AS x, {_PLACE['y']} AS y, {_PLACE['r']} AS r FROM supplier, range(6) q(i) WHERE i < {_PLACE['n']})"
_IDX = "string_agg(i::VARCHAR, ',' ORDER BY {})"


def _line(kind: str, axis: str) -> str:
    return f"SELECT doc_id, '{kind}' AS kind, {_IDX.format('i')} AS idx, {axis}::DOUBLE AS axis, NULL::DOUBLE AS spacing FROM e GROUP BY doc_id, {axis} HAVING count(*) > 1"


def _gaps(kind: str, axis: str, along: str) -> str:
    gaps = f"SELECT *, {along} - lag({along}) OVER w AS gap, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY doc_id, {axis} ORDER BY {along}, i)"
    return f"SELECT doc_id, '{kind}', {_IDX.format('k')}, NULL, avg(gap) FROM ({gaps}) GROUP BY doc_id, {axis} HAVING count(*) >= 3 AND max(gap) - avg(gap) <= 3 AND avg(gap) - min(gap) <= 3"


def _mirror(kind: str, c: str, o: str) -> str:
    side = f"SELECT doc_id, {c} AS c, {o} AS o, r, count(*) AS n FROM e GROUP BY ALL"
    mid = f"SELECT doc_id, (min({c}) + max({c})) / 2.0::DOUBLE AS mid, {_IDX.format('i')} AS idx FROM e GROUP BY doc_id"
    # Every place off the axis has as many elements of a size as its mirrored place.
    odd = f"SELECT DISTINCT a.doc_id FROM ({side}) a JOIN ({mid}) m USING (doc_id) LEFT JOIN ({side}) b ON b.doc_id = a.doc_id AND b.c = 2 * m.mid - a.c AND b.o = a.o AND b.r = a.r WHERE a.c <> m.mid AND coalesce(b.n, 0) <> a.n"
    return f"SELECT doc_id, '{kind}', idx, mid, NULL FROM ({mid}) WHERE doc_id NOT IN ({odd})"


@query(
    "r8_mixed_layouts",
    f"WITH {_LAID} " + " UNION ALL ".join([
        _line("ALIGN_CENTER_H", "y"), _line("ALIGN_CENTER_V", "x"), _gaps("EQUAL_SPACE_H", "y", "x"), _gaps("EQUAL_SPACE_V", "x", "y"), _mirror("SYM_REFLECT_X", "x", "y"), _mirror("SYM_REFLECT_Y", "y", "x"),
        f"SELECT doc_id, 'EQUAL_SIZE', {_IDX.format('i')}, NULL, NULL FROM e GROUP BY doc_id, r HAVING count(*) > 1",
    ]),
)
def r8(spark, d):
    """Relations of layouts with rows, columns, unlike sizes and elements at one place."""
    rows = codec.parsed(layouts(spark, d)).withColumn("info", F.expr(f"transform(elements, (e, n) -> {shapes.info('e', 'n')})"))
    rows = rows.select("doc_id", F.explode(F.expr(relations.relations("info"))).alias("r"))
    return rows.select("doc_id", "r.kind", F.expr("array_join(transform(r.idx, v -> cast(v AS STRING)), ',')").alias("idx"), F.round("r.axis", 6).alias("axis"), F.round("r.spacing", 6).alias("spacing"))
