"""Queries over drawings that reach every kind of command, shape, transform and token."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves, decode, ids, path, relations, shapes, tokens
from ..functions.sqlgen import let, lit
from ..operators import codec, manifest, mldata
from ..sources import svg as source
from . import fixtures as fx
from .core import CUBICS, CONT, PART, SAMPLED, TEXT, d_centre, d_id, d_q, d_scalar, d_trim
from .registry import query


def parts(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    """The numbers of each part's drawing with columns of SQL text."""
    p = fx.spread(fx.table(spark, d, "part")).selectExpr(*[f"cast({v} AS INT) AS {n}" for n, v in fx.PART.items()])
    return p.withColumn("doc_id", F.col("k").cast("long")).withColumns({n: F.expr(v) for n, v in columns.items()})


def text_of(cmds: str) -> str:
    """SQL: commands as text with whole numbers."""
    return f"array_join(transform({cmds}, t -> concat(t.c, array_join(transform(t.p, v -> cast(cast(round(v) AS INT) AS STRING)), ','))), ' ')"


def as_drawn(rows: DataFrame) -> DataFrame:
    """rows, which has svg, with its elements' commands as they stand: no view box, arcs left."""
    return codec.with_commands(source.parse(rows), canvas=None, flatten=False)


# Path grammar and shapes.
@query("g2_chunks", f"WITH {PART} SELECT k::BIGINT AS doc_id, 'M' || x || ',' || y || ' L' || (x+1) || ',' || (y+2) || ' L' || (x+3) || ',' || (y+4) || ' l1,1 l2,2 Z h' || w || ' h' || h AS t FROM p")
def g2(spark, d):
    rows = parts(spark, d, path_text="concat('M ', x, ' ', y, ' ', x + 1, ' ', y + 2, ',', x + 3, ' ', y + 4, 'l1 1 2 2 9z m 5 h', w, ' ', h)").withColumn("c", F.expr(path.chunked(path.lexed("path_text"))))
    return rows.select("doc_id", F.expr(f"replace({text_of('c')}, 'z', 'Z')").alias("t"))


@query(
    "g3_curves",
    f"WITH {PART} SELECT k::BIGINT AS doc_id, 'M' || x || ',' || y || ' C' || (x+1) || ',' || (y+2) || ',' || (x+3) || ',' || (y+4) || ',' || (x+5) || ',' || (y+6) "
    "|| ' C' || (x+7) || ',' || (y+8) || ',' || (x+6) || ',' || (y+7) || ',' || (x+7) || ',' || (y+8) || ' Q' || (x+8) || ',' || (y+9) || ',' || (x+9) || ',' || (y+10) "
    "|| ' Q' || (x+10) || ',' || (y+11) || ',' || (x+12) || ',' || (y+13) || ' A5,6,0,0,1,' || (x+16) || ',' || (y+17) || ' C' || (x+16) || ',' || (y+17) || ',1,1,' || w || ',' || h || ' Z L1,1' AS t FROM p",
)
def g3_curves(spark, d):
    rows = parts(spark, d, path_text="concat('M', x, ' ', y, 'c1 2 3 4 5 6s1 1 2 2q1 1 2 2t3 3a5 6 0 014 4S1 1 ', w, ' ', h, 'zL1 1')")
    return rows.select("doc_id", F.expr(text_of(path.parsed("path_text"))).alias("t"))


_W, _H = "(2 * w)", "(2 * h)"
_I, _J = "CASE k % 4 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN w ELSE 0 END", "CASE k % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN h ELSE 4 END"


@query(
    "g5_rounded_rect",
    f"WITH {PART}, q AS (SELECT *, {_I} AS i, {_J} AS j, {_W} AS ww, {_H} AS hh FROM p) SELECT k::BIGINT AS doc_id, 'M' || (x+i) || ',' || y || ' L' || (x+ww-i) || ',' || y || ' A' || i || ',' || j || ',0,0,1,' || (x+ww) || ',' || (y+j) "
    "|| ' L' || (x+ww) || ',' || (y+hh-j) || ' A' || i || ',' || j || ',0,0,1,' || (x+ww-i) || ',' || (y+hh) || ' L' || (x+i) || ',' || (y+hh) || ' A' || i || ',' || j || ',0,0,1,' || x || ',' || (y+hh-j) "
    "|| ' L' || x || ',' || (y+j) || ' A' || i || ',' || j || ',0,0,1,' || (x+i) || ',' || y || ' Z' AS t FROM q",
)
def g5(spark, d):
    radii = "CASE k % 4 WHEN 0 THEN 'rx=\"5\"' WHEN 1 THEN 'rx=\"6\" ry=\"3\"' WHEN 2 THEN 'rx=\"500\" ry=\"500\"' ELSE 'ry=\"4\"' END"
    rows = parts(spark, d, svg=f"concat('<svg><rect x=\"', x, '\" y=\"', y, '\" width=\"', {_W}, '\" height=\"', {_H}, '\" ', {radii}, '/></svg>')")
    return as_drawn(rows).select("doc_id", F.expr(text_of("elements[0]")).alias("t"))


@query("g8_lines_and_polygons", f"WITH {PART} SELECT k::BIGINT AS doc_id, CASE k % 4 WHEN 0 THEN 'M' || x || ',' || y || ' L' || (x+w) || ',' || (y+h) WHEN 1 THEN 'M' || x || ',' || y || ' L' || (x+w) || ',' || y || ' L-7,' || (y+h) || ' Z' WHEN 2 THEN 'M' || x || ',' || y || ' L' || (x+w) || ',' || y ELSE '' END AS t FROM p")
def g8(spark, d):
    tag = (
        "CASE k % 4 WHEN 0 THEN concat('<line x1=\"', x, '\" y1=\"', y, '\" x2=\"', x + w, '\" y2=\"', y + h, '\"/>') WHEN 1 THEN concat('<polygon points=\"', x, ',', y, ' ', x + w, ' ', y, '-7,', y + h, '\"/>') "
        "WHEN 2 THEN concat('<polyline points=\"', x, ' ', y, ' ', x + w, ' ', y, ' 9\"/>') ELSE concat('<polygon points=\"', x, ',', y, '\"/>') END"
    )
    return as_drawn(parts(spark, d, svg=f"concat('<svg>', {tag}, '</svg>')")).select("doc_id", F.expr(text_of("elements[0]")).alias("t"))


@query("g10_nested_transforms", f"WITH {PART} SELECT k::BIGINT AS doc_id, (2 * (x - y) + tx)::DOUBLE AS ax, (3 * x + ty)::DOUBLE AS ay, (x + tx)::DOUBLE AS bx, (x + y + ty)::DOUBLE AS byy FROM p")
def g10(spark, d):
    inner = "'<g transform=\"scale(2,3)\"><path transform=\"skewX(45) rotate(90)\" d=\"M', x, ' ', y, 'L1 1\"/></g>'"
    rows = parts(spark, d, svg=f"concat('<svg><g transform=\"translate(', tx, ' ', ty, ')\">', {inner}, '<defs><path d=\"M9 9L1 1\"/></defs><path transform=\"skewY(45)\" d=\"M', x, ' ', y, 'L1 1\"/></g></svg>')")
    at = lambda e, a: F.round(F.expr(f"elements[{e}][0].e{a}"), 6)
    return as_drawn(rows).select("doc_id", at(0, "x").alias("ax"), at(0, "y").alias("ay"), at(1, "x").alias("bx"), at(1, "y").alias("byy"))


_VIEW = "s AS (SELECT s_suppkey AS k, s_suppkey % 3 AS m, 10 + s_suppkey % 90 AS w, 20 + s_suppkey % 50 AS h FROM supplier), z AS (SELECT *, CASE WHEN m = 2 THEN 300.0::DOUBLE / greatest(w, h) ELSE 1 END AS f FROM s)"


@query(
    "s3_view_box",
    f"WITH {_VIEW} SELECT k AS doc_id, CASE WHEN m = 2 THEN w ELSE 80 END::DOUBLE AS width, CASE WHEN m = 2 THEN h ELSE 50 END::DOUBLE AS height, m = 2 AS boxed, 3 AS n_commands, "
    "round(10 * f + CASE WHEN m = 2 THEN (300 - w * f) / 2 + 3 * f ELSE 0 END, 6) AS x, round(20 * f + CASE WHEN m = 2 THEN (300 - h * f) / 2 - 4 * f ELSE 0 END, 6) AS y FROM z",
)
def s3(spark, d):
    """Canvas sizes and view boxes as attribute texts: none, one of three numbers, one of four; and the number of commands."""
    s = fx.table(spark, d, "supplier").selectExpr("s_suppkey AS doc_id", "s_suppkey % 3 AS m", "10 + s_suppkey % 90 AS w", "20 + s_suppkey % 50 AS h")
    box = "CASE m WHEN 0 THEN '' WHEN 1 THEN 'viewBox=\"0 0 9\"' ELSE concat('viewBox=\" -3,4 ', w, ' ,', h, '\"') END"
    rows = codec.parsed(s.withColumn("svg", F.expr(f"concat('<svg width=\"80px\" height=\"50%\" ', {box}, '><path d=\"M10 20L1 1\"/><path d=\"M1 1\"/></svg>')"))).withColumn("size", F.expr(source.canvas_size()))
    return rows.select("doc_id", F.col("size.w").alias("width"), F.col("size.h").alias("height"), F.col("doc.viewbox").isNotNull().alias("boxed"), F.expr("aggregate(elements, 0, (n, e) -> n + size(e))").alias("n_commands"), *[F.round(F.expr(f"elements[0][0].e{a}"), 6).alias(a) for a in "xy"])


@query("g20_identity", "SELECT s_suppkey, s_suppkey % 4 < 3 AND s_suppkey % 3 < 2 AND s_suppkey % 5 < 4 AS same FROM supplier")
def g20(spark, d):
    m = path.matrix("1 + (s_suppkey % 4) * 4e-6", "0", "IF(s_suppkey % 5 = 4, -2e-9, 0)", "1", "(s_suppkey % 3) * 6e-10", "0")
    return fx.table(spark, d, "supplier").withColumn("m", F.expr(m)).select("s_suppkey", F.expr(path.is_identity("m")).alias("same"))


@query("f4_pruned_and_styled", f"WITH {PART} SELECT k::BIGINT AS doc_id, 1 AS n_elements, 'g' || k AS gid, 'e1' AS id, CASE WHEN k % 2 = 0 THEN 'class=c,fill=red,stroke-width=2' ELSE 'class=c,stroke-width=2' END AS attributes FROM p")
def f4(spark, d):
    """Containers that aren't drawn are passed over; of the attributes only styles that aren't empty are kept."""
    tag = "element_at(array('defs', 'clipPath', 'mask', 'symbol', 'marker', 'pattern', 'filter', 'style', 'metadata', 'title', 'desc'), cast(k % 11 + 1 AS INT))"
    svg = f"concat('<svg><', {tag}, '><g><path d=\"M1 1L2 2\"/></g></', {tag}, '><g id=\"g', k, '\"><path id=\"e1\" class=\"c\" stroke-width=\"2\" data-x=\"1\" opacity=\"\" fill=\"', IF(k % 2 = 0, 'red', ''), '\" d=\"M1 1L2 2\"/></g></svg>')"
    rows = source.parse(parts(spark, d, svg=svg)).withColumn("e", F.expr("doc.elements[0]"))
    pairs = "array_join(array_sort(transform(map_entries(e.attributes), a -> concat(a.key, '=', a.value))), ',')"
    return rows.select("doc_id", F.expr("size(doc.elements)").alias("n_elements"), "e.gid", "e.id", F.expr(pairs).alias("attributes"))


# Curves.
QUADS = CUBICS[: CUBICS.index("s AS (")] + (
    "s AS (SELECT vec_id, i, x0, y0, x0 + 2::DOUBLE / 3 * (qx - x0) AS x1, y0 + 2::DOUBLE / 3 * (qy - y0) AS y1, x3 + 2::DOUBLE / 3 * (qx - x3) AS x2, y3 + 2::DOUBLE / 3 * (qy - y3) AS y2, x3, y3 "
    "FROM (SELECT vec_id, i, m[4*i+1] AS x0, m[4*i+2] AS y0, m[4*i+3] AS qx, m[4*i+4] AS qy, m[4*i+5] AS x3, m[4*i+6] AS y3 FROM e))"
)


def quads(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, i and k, the i-th of ten quadratics through a vector's points."""
    at = lambda n: f"((cast(embedding[4 * i + {n}] AS DOUBLE) + 0.6D) * 250D)"
    one = path.cmd("Q", [at(2), at(3), at(4), at(5)], at(0), at(1), at(4), at(5))
    return fx.table(spark, d, "embeddings").select("vec_id", F.posexplode(F.expr(f"cast(transform(sequence(0, 9), i -> {one}) AS {path.COMMANDS})")).alias("i", "k"))


@query("c8_quadratics", f"WITH {SAMPLED.replace(CUBICS, QUADS)} SELECT vec_id, i::INT AS i, round(ln(1 + kmax), 5) AS kmax, round(ln(1 + kmean), 5) AS kmean, round(len, 5) AS len, round(atan2(y1-y0, x1-x0), 6) AS t0, round(atan2(y3-y2, x3-x2), 6) AS t1, false AS straight FROM s JOIN g USING (vec_id, i) JOIN q USING (vec_id, i)")
def c8(spark, d):
    rows = quads(spark, d).withColumn("g", F.expr(curves.segment()))
    return rows.select("vec_id", "i", F.round(F.expr("ln(1 + g.kmax)"), 5).alias("kmax"), F.round(F.expr("ln(1 + g.kmean)"), 5).alias("kmean"), F.round("g.len", 5).alias("len"), F.round("g.t0", 6).alias("t0"), F.round("g.t1", 6).alias("t1"), "g.straight")


@query("c1_quadratic_points", f"WITH {QUADS} SELECT vec_id, i::INT AS i, round(x0 / 4 + qx / 2 + x3 / 4, 6) AS x, round(y0 / 4 + qy / 2 + y3 / 4, 6) AS y FROM (SELECT *, x0 + (x1 - x0) * 1.5::DOUBLE AS qx, y0 + (y1 - y0) * 1.5::DOUBLE AS qy FROM s)")
def c1(spark, d):
    """The middle of a quadratic, evaluated as a cubic."""
    middle = let(curves.controls(), f"named_struct('x', {curves.at('x', '0.5D')}, 'y', {curves.at('y', '0.5D')})", "struct<x:double,y:double>")
    return quads(spark, d).withColumn("m", F.expr(middle)).select("vec_id", "i", F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"))


@query("c9_arcs", f"WITH {PART} SELECT k::BIGINT AS doc_id, round(CASE WHEN k % 7 = 0 THEN 0 ELSE 2.0::DOUBLE / (rx + ry) END, 9) AS kmax, round(1.2::DOUBLE * sqrt(w * w + h * h), 6) AS len, round(atan2(h, w), 6) AS theta FROM p")
def c9_arcs(spark, d):
    rows = parts(spark, d, path_text="concat('M', x, ' ', y, 'a', IF(k % 7 = 0, 0, rx), ' ', ry, ' 30 0 1 ', w, ' ', h)").withColumn("g", F.expr(f"element_at(transform({path.parsed('path_text')}, k -> {curves.segment()}), 2)"))
    return rows.select("doc_id", F.round("g.kmax", 9).alias("kmax"), F.round("g.len", 6).alias("len"), F.round("g.t0", 6).alias("theta"))


@query("c12_arc_junctions", f"WITH {PART} SELECT k::BIGINT AS doc_id, '-,-,' || CASE WHEN r < 20 THEN 1 ELSE 2 END || ',' || CASE WHEN r < 20 THEN 1 ELSE 2 END || ',0,-,-,-' AS levels FROM p")
def c12(spark, d):
    """A line, an arc along it, a line along that, a bend; a move and a close."""
    rows = parts(spark, d, path_text="concat('M', x, ' ', y, 'h20a', r, ' ', r, ' 0 0 1 10 0h5l5 5M0 0l1 1z')")
    return rows.select("doc_id", F.expr(f"array_join(transform({curves.analysed(path.parsed('path_text'))}, u -> coalesce(cast(u.level AS STRING), '-')), ',')").alias("levels"))


@query("c14_thresholds", f"WITH {CONT.replace('> 0.1 THEN', '> 0.5 THEN')} SELECT doc_id, (n - 1)::INT AS i, level::INT AS level FROM lv WHERE level IS NOT NULL")
def c14(spark, d):
    """Continuity by thresholds of the caller's, the relative test of curvature among them."""
    th = curves.Thresholds(g1=0.5, relative=True, tolerance=0.5)
    rows = fx.polylines(spark, d).select("doc_id", F.posexplode(F.expr(curves.analysed("elements[0]", th))).alias("i", "u"))
    return rows.filter("u.level IS NOT NULL").select("doc_id", "i", "u.level")


@query("c15_distance", f"WITH {PART} SELECT k::BIGINT AS doc_id, round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 6) AS dist FROM p")
def c15(spark, d):
    cubic = {"x0": "x", "y0": "y", "x1": "x", "y1": "y", "x2": "cx", "y2": "cy", "x3": "cx", "y3": "cy"}
    rows = parts(spark, d)
    return rows.select("doc_id", F.round(F.expr(let({k: f"cast({v} AS DOUBLE)" for k, v in cubic.items()}, curves.length())), 6).alias("dist"))


# The id space.
@query("q17_constructors", "SELECT event_id, (40 + greatest(0, least(15, event_id % 40 - 10)))::INT AS curvature, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 14 WHEN 2 THEN 23 WHEN 3 THEN 33 ELSE 70 END::INT AS symbol, (1465 + least(event_id % 5000, 4095) % 64 * 64 + least(event_id % 5000, 4095) // 64)::INT AS number FROM events")
def q17(spark, d):
    names = F.array(*[F.lit(x) for x in ("BOS", "CUBIC", "ROUND_RECT", "G2", "REPEAT_N")])
    rows = fx.table(spark, d, "events").withColumn("name", F.get(names, (F.col("event_id") % 5).cast("int")))
    return rows.select("event_id", F.expr(ids.curvature_id("event_id % 40 - 10")).alias("curvature"), F.expr(ids.symbol_id("name")).alias("symbol"), F.expr(ids.count_id("event_id % 5000")).alias("number"))


@query("q18_level_layout", "SELECT l::INT AS level, (100 + (pow(4, l)::INT - 1) // 3)::INT AS start_id, pow(2, l)::INT AS grid, pow(4, l)::INT AS n_tokens FROM range(7) r(l)")
def q18(spark, d):
    return spark.createDataFrame([(x["level"], x["start_id"], x["grid"], x["n_tokens"]) for x in manifest.build()["level_layout"]], "level int, start_id int, grid int, n_tokens int")


# Tokens.
_MARKS = (
    SAMPLED + ", j2 AS (SELECT s.*, kmax, a.k AS k0, b.k AS k1, atan2(y1-y0, x1-x0) AS t0, atan2(y3-y2, x3-x2) AS t1 FROM s JOIN g USING (vec_id, i) JOIN c a ON a.vec_id = s.vec_id AND a.i = s.i AND a.j = 0 JOIN c b ON b.vec_id = s.vec_id AND b.i = s.i AND b.j = 29), "
    "l AS (SELECT *, lag(t1) OVER v AS pt, lag(k1) OVER v AS pk FROM j2 WINDOW v AS (PARTITION BY vec_id ORDER BY i))"
)


@query(
    "t1_cubic_tokens",
    f"WITH {_MARKS} SELECT vec_id, '1,10,' || max({d_id('x0', 'y0')}) FILTER (WHERE i = 0) || ',' || string_agg('14,' || {d_id('x1', 'y1')} || ',' || {d_id('x2', 'y2')} || ',' || {d_id('x3', 'y3')} "
    "|| CASE WHEN pt IS NULL THEN '' WHEN least(abs(pt - t0), 2 * pi() - abs(pt - t0)) > 0.1 THEN ',31' WHEN abs(pk - k0) > 0.05 THEN ',32' ELSE ',33' END "
    "|| CASE WHEN kmax < 1e-4 THEN '' ELSE ',' || (40 + least(floor(ln(1 + kmax * 100) / 5 * 16)::INT, 15)) END, ',' ORDER BY i) || ',2' AS t FROM l GROUP BY vec_id",
)
def t1_cubics(spark, d):
    rows = codec.l1(fx.cubics(spark, d).select("vec_id", F.array("cmds").alias("elements")))
    return rows.select("vec_id", F.expr(TEXT).alias("t"))


#: The golden vector of the format: a triangle and a circle in a view box, with and without markers.
GOLDEN = "<svg viewBox='0 0 24 24'><path d='M4 4 L20 4 L20 20 Z'/><circle cx='12' cy='12' r='6'/></svg>"
_FULL = "1,10,2115,11,2158,11,4910,31,17,3,10,3561,14,4073,4577,4569,42,14,4560,4041,3529,33,42,14,2953,2512,2521,33,42,14,2529,2985,3561,33,42,17,2"
_BARE = "1,10,2115,11,2158,11,4910,17,3,10,3561,14,4073,4577,4569,14,4560,4041,3529,14,2953,2512,2521,14,2529,2985,3561,17,2"


@query("t1_golden_vector", f"SELECT * FROM (VALUES (false, '{_FULL}', 37, 2), (true, '{_BARE}', 29, 2)) v(lean, t, n_tokens, n_elements)")
def t1_golden(spark, d):
    docs = spark.createDataFrame([(GOLDEN,)], "svg string")
    both = codec.tokenize(docs).unionByName(codec.tokenize(docs, lean=True))
    return both.select("lean", F.expr(TEXT).alias("t"), "n_tokens", "n_elements")


@query("t2_lean_curves", f"WITH {PART} SELECT k::BIGINT AS doc_id, '10,' || {d_id('x', 'y')} || ',15,' || {d_id('x + w', 'y')} || ',' || {d_id('x + w', 'y + h')} || ',16,' || {d_id('20', '30')} || ',' || {d_id('cx', 'cy')} || ',12,' || {d_id('x', 'cy')} || ',13,' || {d_id('x', 'y')} || ',17' AS t FROM p")
def t2(spark, d):
    rows = parts(spark, d, path_text="concat('M', x, ' ', y, 'q', w, ' 0 ', w, ' ', h, 'A20 30 0 0 1 ', cx, ' ', cy, 'H', x, 'V', y, 'z')")
    return rows.select("doc_id", F.expr(f"array_join(transform({tokens.lean(path.parsed('path_text'))}, v -> cast(v AS STRING)), ',')").alias("t"))


_BW, _BH, _RX, _RY = "(2 * w + 20)", "(2 * h + 20)", "(5 + k % 6)", "(4 + k % 5)"


def rounded(spark, d):
    svg = f"concat('<svg><rect x=\"', x, '\" y=\"', y, '\" width=\"', {_BW}, '\" height=\"', {_BH}, '\" rx=\"', {_RX}, '\" ry=\"', {_RY}, '\"/></svg>')"
    return codec.parsed(parts(spark, d, svg=svg))


@query("r5_round_rects", f"WITH {PART} SELECT k::BIGINT AS doc_id, 'round_rect' AS shape, 0.85::DOUBLE AS confidence, x || ',' || y || ',' || {_BW} || ',' || {_BH} || ',' || {_RX} || ',' || {_RY} AS p FROM p")
def r5(spark, d):
    rows = rounded(spark, d).select("doc_id", F.explode(F.expr(f"flatten(transform(elements, e -> {shapes.detected('e')}))")).alias("x"))
    return rows.select("doc_id", "x.shape", F.col("x.confidence").alias("confidence"), F.expr("array_join(transform(x.p, v -> cast(cast(round(v) AS INT) AS STRING)), ',')").alias("p"))


@query("t10_round_rect_tokens", f"WITH {PART} SELECT k::BIGINT AS doc_id, '1,23,' || {d_id('x', 'y')} || ',' || {d_scalar(_BW)} || ',' || {d_scalar(_BH)} || ',' || {d_scalar(_RX)} || ',' || {d_scalar(_RY)} || ',2' AS t FROM p")
def t10(spark, d):
    rows = rounded(spark, d).withColumn("token_ids", F.expr(tokens.bracketed(f"transform(elements, e -> {shapes.composite('e')})")))
    return rows.select("doc_id", F.expr(TEXT).alias("t"))


@query("t14_without_relations", f"WITH {PART} SELECT k::BIGINT AS doc_id, '1,20,' || {d_id('40 + tx', '40 + ty')} || ',' || {d_scalar('10')} || ',3,22,' || {d_id('150 + x // 4', '201')} || ',' || {d_scalar('37')} || ',' || {d_scalar('61')} || ',2' AS t FROM p")
def t14(spark, d):
    """Shapes that have nothing to do with each other stand one after another."""
    svg = "concat('<svg><circle cx=\"', 40 + tx, '\" cy=\"', 40 + ty, '\" r=\"10\"/><rect x=\"', 150 + x DIV 4, '\" y=\"201\" width=\"37\" height=\"61\"/></svg>')"
    rows = codec.parsed(parts(spark, d, svg=svg)).withColumn("info", F.expr(f"transform(elements, (e, n) -> {shapes.info('e', 'n')})")).withColumn("b", F.expr(f"transform(elements, e -> {shapes.composite('e')})"))
    return rows.select("doc_id", F.expr(f"array_join(transform({relations.stream('b', 'info')}, v -> cast(v AS STRING)), ',')").alias("t"))


# What the library's front door returns.
def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, svg: a line, an element that draws nothing, and a line in a moved element."""
    return parts(spark, d, svg="concat('<svg width=\"300\" height=\"300\"><path d=\"M', x, ' ', y, 'L', x + w, ' ', y + h, 'L', 2 * cx, ' ', cy, '\"/><path transform=\"scale(2)\" d=\"\"/><path transform=\"translate(1 0)\" d=\"M1 1L2 2\"/></svg>')").select("doc_id", "svg")


_DOCS = (
    f"{PART}, v AS (SELECT k::BIGINT AS doc_id, '<svg width=\"300\" height=\"300\"><path d=\"M' || x || ' ' || y || 'L' || (x+w) || ' ' || (y+h) || 'L' || (2*cx) || ' ' || cy || '\"/><path transform=\"scale(2)\" d=\"\"/><path transform=\"translate(1 0)\" d=\"M1 1L2 2\"/></svg>' AS svg, "
    f"{d_id('x', 'y')} AS a, {d_id('x + w', 'y + h')} AS b, {d_id('2 * cx', 'cy')} AS c, 2 * cx > 300 AS beyond FROM p)"
)
_LEAN_T = "'1,10,' || a || ',11,' || b || ',11,' || c || ',3,10,1465,11,1465,2'"
_CLAMPED = "CASE WHEN beyond THEN '1 coordinate(s) outside viewBox were clamped to canvas' ELSE '' END"
_SYMBOL = lambda v: f"'C6:' || (({v} - 1465) % 64) || ',' || (({v} - 1465) // 64)"


@query(
    "t6_payload",
    f"WITH {_DOCS} SELECT doc_id, 'strokeforge-1.0.0' AS tokenizer_version, 'geom-5561-v1' AS vocab_id, 'L1' AS level, true AS lean, {_LEAN_T} AS t, "
    f"'BOS MOVE ' || {_SYMBOL('a')} || ' LINE ' || {_SYMBOL('b')} || ' LINE ' || {_SYMBOL('c')} || ' SEP MOVE C6:0,0 LINE C6:0,0 EOS' AS symbols, 5 AS n_commands, 13 AS n_tokens, 2 AS n_elements, "
    f"round_even(length(svg) / 13.0::DOUBLE, 4) AS compression_ratio, false AS boxed, 1 AS moved, {_CLAMPED} AS warnings FROM v",
)
def t6(spark, d):
    rows = codec.tokenize(documents(spark, d), lean=True)
    return rows.select(
        "doc_id", "tokenizer_version", "vocab_id", "level", "lean", F.expr(TEXT).alias("t"), F.array_join("tokens", " ").alias("symbols"), "n_commands", "n_tokens", "n_elements", "compression_ratio",
        F.col("normalization.viewBox_applied").alias("boxed"), F.col("normalization.transforms_flattened").alias("moved"), F.array_join("warnings", "; ").alias("warnings"),
    )


_SAID = "CASE asked WHEN 'L1' THEN NULL WHEN 'l2+' THEN 'L2 merges were learned on full (marker) L1 streams; lean+L2 compression may be suboptimal' WHEN 'L2' THEN 'L2 merges unavailable; falling back to L1' WHEN 'L3' THEN 'L3 spatial is experimental; emitting L1 substrate' ELSE 'unknown level ''L9''; emitting L1' END"


@query("f9_levels", f"WITH {_DOCS} SELECT doc_id, asked, CASE asked WHEN 'l2+' THEN 'L2' ELSE 'L1' END AS level, CASE asked WHEN 'l2+' THEN 12 ELSE 13 END::INT AS n_tokens, concat_ws('; ', nullif({_CLAMPED}, ''), {_SAID}) AS warnings FROM v CROSS JOIN (VALUES ('L1'), ('l2+'), ('L2'), ('L3'), ('L9')) l(asked)")
def f9(spark, d):
    out = None
    for asked in ("L1", "l2+", "L2", "L3", "L9"):
        rows = codec.tokenize(documents(spark, d), level=asked.rstrip("+"), lean=True, merges=[[11, 1465, 5561]] if asked == "l2+" else None)
        rows = rows.select("doc_id", F.lit(asked).alias("asked"), "level", "n_tokens", F.array_join("warnings", "; ").alias("warnings"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("f6_projection", f"WITH {_DOCS} SELECT doc_id, 'strokeforge-1.0.0' AS tokenizer_version, 'geom-5561-v1' AS vocab_id, 'L1' AS level, true AS lean, 13 AS n_tokens, {_CLAMPED} AS warnings, {_LEAN_T} AS token_ids FROM v")
def f6(spark, d):
    """The fields asked for and those that are always kept, lists as text."""
    rows = codec.project(codec.tokenize(documents(spark, d), lean=True), ["token_ids"], ["doc_id"])
    return rows.select(*[F.array_join(F.col(c).cast("array<string>"), "; " if c == "warnings" else ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes])


@query("f7_empty_elements", f"WITH {_DOCS} SELECT doc_id, 1 AS n_separators, 3 AS n_parsed, 2 AS n_elements FROM v")
def f7(spark, d):
    rows = codec.l1(codec.parsed(documents(spark, d)))
    return rows.select("doc_id", F.expr("size(filter(token_ids, t -> t = 3))").alias("n_separators"), F.expr("size(elements)").alias("n_parsed"), F.expr("size(filter(elements, e -> size(e) > 0))").alias("n_elements"))


@query("t8_class_ratio", f"WITH {_DOCS} SELECT doc_id, round(13.0::DOUBLE / length(svg), 9) AS by_text, round(13.0::DOUBLE / 100, 9) AS by_commands FROM v")
def t8(spark, d):
    rows = codec.tokenize(documents(spark, d), lean=True)
    return rows.select("doc_id", F.round(F.expr(tokens.class_ratio("n_tokens", "n_commands", "length(svg)")), 9).alias("by_text"), F.round(F.expr(tokens.class_ratio("n_tokens", "n_commands")), 9).alias("by_commands"))


@query("t18_facade", f"WITH {_DOCS} SELECT doc_id, {_LEAN_T} AS t, true AS valid FROM v")
def t18(spark, d):
    """The package's own functions, there and back."""
    import strokeforge

    there = strokeforge.tokenize(documents(spark, d), lean=True).select("doc_id", "token_ids", "tokenizer_version", "vocab_id")
    return strokeforge.detokenize(there).select("doc_id", F.expr(TEXT).alias("t"), "valid")


# Decoding.
def _xy(x: str, y: str) -> str:
    return f"{d_trim(d_centre(d_q(x)))} || ' ' || {d_trim(d_centre(d_q(y)))}"


@query("k2_curves", f"WITH {PART} SELECT k::BIGINT AS doc_id, 'M ' || {_xy('x', 'y')} || ' C ' || {_xy('x + 1', 'y + 5')} || ', ' || {_xy('cx', 'y')} || ', ' || {_xy('cx', 'cy')} || ' Q ' || {_xy('x', 'cy')} || ', ' || {_xy('x + w', 'y + h')} || ' A ' || {_xy('20', '30')} || ' 0 0 1 ' || {_xy('cx', 'cy')} || ' H ' || {d_trim(d_centre(d_q('x')))} || ' V ' || {d_trim(d_centre(d_q('y')))} || ' Z' AS d FROM p")
def k2(spark, d):
    rows = parts(spark, d, path_text="concat('M', x, ' ', y, 'C', x + 1, ' ', y + 5, ' ', cx, ' ', y, ' ', cx, ' ', cy, 'Q', x, ' ', cy, ' ', x + w, ' ', y + h, 'A20 30 0 0 1 ', cx, ' ', cy, 'H', x, 'V', y, 'z')")
    return rows.withColumn("token_ids", F.expr(tokens.lean(path.parsed("path_text")))).select("doc_id", F.expr(decode.path_text("token_ids")).alias("d"))


_AT2 = lambda v: d_trim(d_centre(d_q(v)), 2)
_SC2 = lambda v: d_trim(f"round_even(greatest(0, least({v}, 300))::DOUBLE / 300 * 4095, 0) / 4095 * 300", 2)
_STYLE = "' fill=\"none\" stroke=\"black\" stroke-width=\"1\"/>'"


@query("k4_elements", f"WITH {PART} SELECT k::BIGINT AS doc_id, '<path d=\"M ' || {_xy('x', 'y')} || ' L ' || {_xy('cx', 'cy')} || '\"' || {_STYLE} || '|<circle cx=\"' || {_AT2('cx')} || '\" cy=\"' || {_AT2('cy')} || '\" r=\"' || {_SC2('r')} || '\"' || {_STYLE} || '|<path d=\"M ' || {_xy('x', 'y')} || '\"' || {_STYLE} AS elements FROM p")
def k4(spark, d):
    at = lambda x, y: ids.coord_id(f"cast({x} AS DOUBLE)", f"cast({y} AS DOUBLE)")
    rows = parts(spark, d, token_ids=f"array(1, 10, {at('x', 'y')}, 11, {at('cx', 'cy')}, 31, 3, 20, {at('cx', 'cy')}, {ids.scalar_id('cast(r AS DOUBLE)')}, 3, 10, {at('x', 'y')}, 2)")
    return rows.select("doc_id", F.expr(f"array_join({decode.element_list('token_ids')}, '|')").alias("elements"))


_AXIS = "2048.0::DOUBLE / 4095 * 300"  # 150, as a code decodes
_P1 = lambda v: f"regexp_replace(printf('%.1f', {v}), '\\.?0+$', '')"


@query(
    "k7_mirrored_shapes",
    f"WITH {PART}, q AS (SELECT *, {_AT2('cx')}::DOUBLE AS a, {_AT2('cy')}::DOUBLE AS b, {_AT2('x')}::DOUBLE AS c, {_AT2('y')}::DOUBLE AS e, {_SC2('r')}::DOUBLE AS dr, {_SC2('rx')}::DOUBLE AS drx, {_SC2('ry')}::DOUBLE AS dry, {_SC2('w')}::DOUBLE AS dw, {_SC2('h')}::DOUBLE AS dh FROM p) "
    f"SELECT k::BIGINT AS doc_id, 2 AS n, CASE kind WHEN 0 THEN '<circle cx=\"' || {_P1(f'2 * {_AXIS} - a')} || '\" cy=\"' || {_P1('b')} || '\" r=\"' || {_P1('dr')} WHEN 2 THEN '<ellipse cx=\"' || {_P1('a')} || '\" cy=\"' || {_P1(f'2 * {_AXIS} - b')} || '\" rx=\"' || {_P1('drx')} || '\" ry=\"' || {_P1('dry')} "
    f"WHEN 1 THEN '<rect x=\"' || {_P1(f'2 * {_AXIS} - c - dw')} || '\" y=\"' || {_P1('e')} || '\" width=\"' || {_P1('dw')} || '\" height=\"' || {_P1('dh')} ELSE '<rect x=\"' || {_P1('c')} || '\" y=\"' || {_P1(f'2 * {_AXIS} - e - dh')} || '\" width=\"' || {_P1('dw')} || '\" height=\"' || {_P1('dh')} END || '\"' || {_STYLE} AS element FROM q",
)
def k7(spark, d):
    """A shape and its mirror image about the middle: circles and some rectangles sideways, the others upside down."""
    at = lambda x, y: ids.coord_id(f"cast({x} AS DOUBLE)", f"cast({y} AS DOUBLE)")
    sc = lambda v: ids.scalar_id(f"cast({v} AS DOUBLE)")
    body = f"CASE kind WHEN 0 THEN array(20, {at('cx', 'cy')}, {sc('r')}, 62) WHEN 2 THEN array(21, {at('cx', 'cy')}, {sc('rx')}, {sc('ry')}, 63) ELSE array(22, {at('x', 'y')}, {sc('w')}, {sc('h')}, IF(kind = 1, 62, 63)) END"
    rows = parts(spark, d, token_ids=f"concat(array(1), {body}, array({sc('150')}, 2))", tokenizer_version=lit(ids.TOKENIZER_VERSION))
    out = codec.detokenize(rows.select("doc_id", "token_ids", "tokenizer_version"))
    lines = "filter(split(svg, '\\n'), z -> z LIKE '  <%')"
    return out.select("doc_id", F.expr(f"size({lines})").alias("n"), F.trim(F.expr(f"element_at({lines}, 2)")).alias("element"))


# Data for training.
@query("m2_length_filter", "WITH s AS (SELECT l_orderkey AS doc_id, 2 * count(*) + 2 AS n FROM lineitem GROUP BY l_orderkey) SELECT doc_id, n::INT AS n FROM s WHERE n <= 8")
def m2(spark, d):
    return mldata.length_filter(fx.streams(spark, d), 8).select("doc_id", F.size("token_ids").alias("n"))


@query("m11_parameters", "SELECT d::INT AS d_model, (5561 * d + 7 * 16 + 6 * 32 + 6 + (d + 16 + 32) * d + 4 * (4 * d * d + 2 * d * 4 * d + 2 * d) + 5561 * d)::BIGINT AS n FROM (VALUES (64), (128), (256)) v(d)")
def m11(spark, d):
    return spark.createDataFrame([(m, mldata.parameters(5561, m, 16, 32, 4 * m, 4)) for m in (64, 128, 256)], "d_model int, n long")


@query(
    "m10_loss",
    "WITH x AS (SELECT vec_id, label % 8 AS target, embedding::DOUBLE[] AS z FROM embeddings), s AS (SELECT vec_id, target, z, list_sum(list_transform(z, lambda v: exp(v))) AS t, list_position(z, list_max(z)) - 1 AS best FROM x WHERE target <> 0) "
    "SELECT count(*) AS n, round(avg(ln(t) - z[target + 1]), 6) AS loss, round(avg((best = target)::INT), 6) AS accuracy FROM s",
)
def m10(spark, d):
    """Cross entropy and accuracy of rows of logits, targets that are padding left out."""
    rows = fx.table(spark, d, "embeddings").select(F.expr("cast(label % 8 AS INT)").alias("target"), F.expr("transform(embedding, v -> cast(v AS DOUBLE))").alias("logits"))
    out = mldata.loss(rows, "logits", "target")
    return out.select("n", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))
