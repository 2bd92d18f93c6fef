"""Queries over the relational tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves, decode, grammar, ids, path, relations, shapes, tokens
from ..operators import bpe, codec, evaluation, manifest, mldata, quadtree, sampling, service
from ..sources import svg as source
from . import fixtures as fx
from .registry import query

# DuckDB's side of the id space.
def d_q(v: str) -> str:
    return f"least(floor(greatest(0, least({v}, 299.999999::DOUBLE)) / 4.6875::DOUBLE), 63)::INT"


def d_id(x: str, y: str) -> str:
    return f"(1465 + {d_q(y)} * 64 + {d_q(x)})"


def d_centre(q: str) -> str:
    return f"(({q} + 0.5::DOUBLE) * 4.6875::DOUBLE)"


def d_scalar(v: str) -> str:
    code = f"round_even(greatest(0, least({v}, 300))::DOUBLE / 300 * 4095, 0)::INT"
    return f"(1465 + ({code}) % 64 * 64 + ({code}) // 64)"


def d_trim(v: str, places: int = 1) -> str:
    return f"regexp_replace(printf('%.{places}f', {v}), '\\.?0+$', '')"


EVENTS = "p AS (SELECT event_id, value AS x, ((event_id * 37) % 300 + 0.25)::DOUBLE AS y FROM events)"
LINES = "l AS (SELECT l_orderkey AS doc_id, l_quantity * 6 AS x, l_extendedprice / 350 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)"
CUBICS = (
    "e AS (SELECT vec_id, unnest(range(10)) AS i, list_transform(embedding, lambda v: (v::DOUBLE + 0.6::DOUBLE) * 250) AS m FROM embeddings), "
    "s AS (SELECT vec_id, i, m[6*i+1] AS x0, m[6*i+2] AS y0, m[6*i+3] AS x1, m[6*i+4] AS y1, m[6*i+5] AS x2, m[6*i+6] AS y2, m[6*i+7] AS x3, m[6*i+8] AS y3 FROM e)"
)
_D1 = "(3*(1-t)*(1-t)*({a}1-{a}0) + 6*(1-t)*t*({a}2-{a}1) + 3*t*t*({a}3-{a}2))"
_D2 = "(6*(1-t)*({a}2-2*{a}1+{a}0) + 6*t*({a}3-2*{a}2+{a}1))"
_AT = "((1-t)*(1-t)*(1-t)*{a}0 + 3*(1-t)*(1-t)*t*{a}1 + 3*(1-t)*t*t*{a}2 + t*t*t*{a}3)"
SAMPLED = (
    CUBICS + ", j AS (SELECT *, j::DOUBLE / 29 AS t FROM s, range(30) AS r(j)), "
    f"d AS (SELECT vec_id, i, j, {_D1.format(a='x')} AS ux, {_D1.format(a='y')} AS uy, {_D2.format(a='x')} AS wx, {_D2.format(a='y')} AS wy FROM j), "
    "c AS (SELECT vec_id, i, j, CASE WHEN pow(sqrt(ux*ux+uy*uy), 3) < 1e-12 THEN 0 ELSE (ux*wy-uy*wx)/pow(sqrt(ux*ux+uy*uy), 3) END AS k FROM d), "
    "g AS (SELECT vec_id, i, max(abs(k)) AS kmax, avg(abs(k)) AS kmean FROM c GROUP BY ALL), "
    f"z AS (SELECT vec_id, i, j, {_AT.format(a='x')} AS x, {_AT.format(a='y')} AS y FROM (SELECT *, j::DOUBLE / 59 AS t FROM s, range(60) AS r(j))), "
    "w AS (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py FROM z WINDOW v AS (PARTITION BY vec_id, i ORDER BY j)), "
    "q AS (SELECT vec_id, i, sum(sqrt((x-px)*(x-px)+(y-py)*(y-py))) AS len FROM w WHERE j > 0 GROUP BY ALL)"
)
PART = "p AS (SELECT " + ", ".join(f"({v})::INT AS {n}" for n, v in fx.PART.items()) + " FROM part)"
TOKENS = f"lean AS (SELECT doc_id, '1,' || string_agg((CASE WHEN n = 1 THEN '10,' ELSE '11,' END) || {d_id('x', 'y')}, ',' ORDER BY n) || ',2' AS t FROM l GROUP BY doc_id)"
#: The lean streams of polylines in long form: pos from 0.
LONG = (
    LINES + f", t AS (SELECT doc_id, 2 * n - 1 AS pos, CASE WHEN n = 1 THEN 10 ELSE 11 END AS tok FROM l UNION ALL SELECT doc_id, 2 * n, {d_id('x', 'y')} FROM l "
    "UNION ALL SELECT DISTINCT doc_id, 0, 1 FROM l UNION ALL SELECT doc_id, 2 * max(n) + 1, 2 FROM l GROUP BY doc_id)"
)
TEXT = "array_join(transform(token_ids, v -> cast(v AS STRING)), ',')"


@query("q1_quantize", f"WITH {EVENTS} SELECT event_id, {d_q('x')} AS qx, {d_q('y')} AS qy FROM p")
def q1(spark, d):
    return fx.points(spark, d).select("event_id", F.expr(ids.quantised("x")).alias("qx"), F.expr(ids.quantised("y")).alias("qy"))


@query("q2_dequantize", f"WITH {EVENTS} SELECT event_id, {d_centre(d_q('x'))} AS rx, {d_centre(d_q('y'))} AS ry FROM p")
def q2(spark, d):
    t = ids.coord_id("x", "y")
    return fx.points(spark, d).select("event_id", F.expr(ids.x_of(t)).alias("rx"), F.expr(ids.y_of(t)).alias("ry"))


ERR = f"sqrt(pow(x - {d_centre(d_q('x'))}, 2) + pow(y - {d_centre(d_q('y'))}, 2))"


def s_err() -> str:
    t = ids.coord_id("x", "y")
    return f"sqrt(power(x - {ids.x_of(t)}, 2) + power(y - {ids.y_of(t)}, 2))"


@query("q6_quant_error", f"WITH {EVENTS} SELECT event_id, round({ERR}, 6) AS err FROM p")
def q6(spark, d):
    return fx.points(spark, d).select("event_id", F.round(F.expr(s_err()), 6).alias("err"))


@query("q7_bound", "SELECT i::INT AS level, round(300::DOUBLE / pow(2, i) / 2 * sqrt(2), 6) AS bound FROM range(7) r(i)")
def q7(spark, d):
    return spark.range(7).select(F.col("id").cast("int").alias("level"), F.round(F.expr(ids.bound("id")), 6).alias("bound"))


@query("q8_scalar_codec", f"WITH {EVENTS} SELECT event_id, {d_scalar('x')} AS token_id, round(round_even(greatest(0, least(x, 300)) / 300 * 4095, 0) / 4095 * 300, 6) AS back FROM p")
def q8(spark, d):
    rows = fx.points(spark, d).withColumn("token_id", F.expr(ids.scalar_id("x")))
    return rows.select("event_id", "token_id", F.round(F.expr(ids.scalar_of("token_id")), 6).alias("back"))


@query("q9_count_codec", "SELECT o_orderkey, (1465 + least(o_custkey % 5000, 4095) % 64 * 64 + least(o_custkey % 5000, 4095) // 64)::INT AS token_id, least(o_custkey % 5000, 4095)::INT AS back FROM orders")
def q9(spark, d):
    rows = fx.table(spark, d, "orders").select("o_orderkey", F.expr(ids.count_id("o_custkey % 5000")).alias("token_id"))
    return rows.withColumn("back", F.expr(ids.code_of("token_id")))


@query("q10_scalar_bound", "SELECT round(300::DOUBLE / 4095 / 2, 9) AS bound, 4096 AS codes")
def q10(spark, d):
    return spark.range(1).select(F.round(F.lit(ids.scalar_bound()), 9).alias("bound"), F.lit(ids.SCALARS).alias("codes"))


@query("q11_fidelity", f"WITH {EVENTS}, e AS (SELECT {ERR} AS err FROM p) SELECT round(max(err), 6) AS max_error, round(avg(err), 6) AS mean_error, round(sqrt(avg(err*err)), 6) AS rms_error, round(300::DOUBLE/64/2*sqrt(2), 6) AS theoretical_bound, max(err) <= 300::DOUBLE/64/2*sqrt(2) + 1e-6 AS within_bound, count(*) AS n_points FROM e")
def q11(spark, d):
    """Every point counts, those beyond the canvas too, which break the bound."""
    return evaluation.fidelity(fx.points(spark, d), "x", "y")


@query("q13_coord_id", f"WITH {EVENTS} SELECT event_id, {d_id('x', 'y')} AS token_id FROM p")
def q13(spark, d):
    return fx.points(spark, d).select("event_id", F.expr(ids.coord_id("x", "y")).alias("token_id"))


_NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in ids.SYMBOLS.items())
_KINDS = "CASE WHEN t < 5 THEN 'special' WHEN t BETWEEN 10 AND 17 THEN 'command' WHEN t BETWEEN 20 AND 23 THEN 'composite' WHEN t BETWEEN 30 AND 33 THEN 'continuity' WHEN t BETWEEN 40 AND 55 THEN 'curvature' WHEN t BETWEEN 60 AND 70 THEN 'spatial' WHEN t >= 100 THEN 'coord' ELSE 'unknown' END"
VOCAB_SQL = (
    "v AS (SELECT i::INT AS t, (SELECT max(l) FROM range(7) r(l) WHERE 100 + (pow(4, l)::INT - 1) // 3 <= i AND i >= 100)::INT AS l FROM range(5561) r(i)), "
    "u AS (SELECT *, t - 100 - (pow(4, l)::INT - 1) // 3 AS o, pow(2, l)::INT AS g FROM v), "
    f"y AS (SELECT t AS token_id, {_KINDS} AS kind, CASE t {_NAMES} ELSE CASE WHEN t BETWEEN 40 AND 55 THEN 'CURV@' || (t - 40) WHEN t >= 100 THEN 'C' || l || ':' || (o % g) || ',' || (o // g) ELSE '?' || t END END AS symbol FROM u)"
)


def used(spark: SparkSession, d: str) -> DataFrame:
    """token_id and n, how often the orders' streams hold it."""
    return fx.streams(spark, d).select(F.explode("token_ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, pos, token_id of the orders' streams."""
    return fx.streams(spark, d).select("doc_id", F.posexplode("token_ids").alias("pos", "token_id"))


@query("q14_decode_id", f"WITH {VOCAB_SQL}, {LONG}, n AS (SELECT tok, count(*) AS n FROM t GROUP BY tok) SELECT y.*, coalesce(n.n, 0)::BIGINT AS n FROM y LEFT JOIN n ON n.tok = y.token_id")
def q14(spark, d):
    """What every id means, and how often the orders' streams say it."""
    return manifest.vocabulary(spark).join(used(spark, d), "token_id", "left").select("token_id", "kind", "symbol", F.coalesce("n", F.lit(0)).alias("n"))


@query("q16_vocab_summary", f"WITH {VOCAB_SQL}, {LONG}, n AS (SELECT tok, count(*) AS n FROM t GROUP BY tok) SELECT kind, count(*) AS n, count(n.tok) AS n_used, coalesce(sum(n.n), 0)::BIGINT AS uses FROM y LEFT JOIN n ON n.tok = y.token_id GROUP BY kind")
def q16(spark, d):
    """How many ids of each kind there are, how many of them the orders' streams use, and how often."""
    rows = manifest.vocabulary(spark).join(used(spark, d), "token_id", "left").groupBy("kind").agg(F.count("n").alias("n_used"), F.coalesce(F.sum("n"), F.lit(0)).alias("uses"))
    return manifest.summary(spark).join(rows, "kind")


def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, i and the segment g of each cubic, with its box."""
    rows = fx.cubics(spark, d).select("vec_id", F.posexplode(F.expr(f"transform(filter(cmds, k -> k.c = 'C'), k -> named_struct('k', k, 'g', {curves.segment()}))")).alias("i", "s"))
    return rows.select("vec_id", "i", "s.g.*", F.expr("least(s.k.sx, s.k.ex)").alias("x0"), F.expr("least(s.k.sy, s.k.ey)").alias("y0"), F.expr("greatest(s.k.sx, s.k.ex)").alias("x1"), F.expr("greatest(s.k.sy, s.k.ey)").alias("y1"))


_GRID = (
    SAMPLED + ", b AS (SELECT s.vec_id, kmax * len AS c, greatest(0, trunc(least(x0, x3) / 300 * 64)::INT) AS a, least(63, trunc(greatest(x0, x3) / 300 * 64)::INT) AS b, "
    "greatest(0, trunc(least(y0, y3) / 300 * 64)::INT) AS e, least(63, trunc(greatest(y0, y3) / 300 * 64)::INT) AS f FROM s JOIN g USING (vec_id, i) JOIN q USING (vec_id, i)), "
    "cells AS (SELECT vec_id, unnest(range(a, b + 1)) AS gx, e, f, c FROM b WHERE a <= b AND e <= f), grid AS (SELECT vec_id, gx, gy, sum(c) AS c FROM (SELECT vec_id, gx, unnest(range(e, f + 1)) AS gy, c FROM cells) GROUP BY ALL)"
)


@query("q3_complexity_grid", f"WITH {_GRID} SELECT vec_id, gx::INT AS gx, gy::INT AS gy, round(c, 4) AS c FROM grid")
def q3(spark, d):
    rows = segment_rows(spark, d).withColumn("c", F.col("kmax") * F.col("len"))
    return quadtree.complexity(rows, "vec_id").select("vec_id", "gx", "gy", F.round("c", 4).alias("c"))


_SPLIT = (
    _GRID + ", n AS (SELECT vec_id, l, (64 / pow(2, l))::INT AS size, gx, gy, c FROM grid, range(6) r(l)), "
    "nx AS (SELECT *, gx // size AS x FROM n UNION ALL SELECT *, gx // size - 1 FROM n WHERE gx % size = 0 AND gx > 0), "
    "ny AS (SELECT *, gy // size AS y FROM nx UNION ALL SELECT *, gy // size - 1 FROM nx WHERE gy % size = 0 AND gy > 0), "
    "h AS (SELECT vec_id, l, x, y FROM ny GROUP BY ALL HAVING sum(c) > 0.5)"
)


@query("q4_split_nodes", f"WITH {_SPLIT} SELECT vec_id, count(*)::INT AS n_nodes, sum(l * 4096 + y * 64 + x)::BIGINT AS codes FROM h GROUP BY vec_id")
def q4(spark, d):
    rows = segment_rows(spark, d).withColumn("c", F.col("kmax") * F.col("len"))
    s = quadtree.nodes(rows, "vec_id")
    return s.select("vec_id", F.size("nodes").alias("n_nodes"), F.expr("aggregate(nodes, 0L, (a, v) -> a + v)").alias("codes"))


_LEAF = (
    _SPLIT + ", o AS (SELECT vec_id, i, greatest(0, least(x0, 299.999999::DOUBLE)) AS px, greatest(0, least(y0, 299.999999::DOUBLE)) AS py FROM s), "
    "k AS (SELECT o.vec_id, i, l.l, h.l IS NOT NULL AS splits FROM o CROSS JOIN range(6) l(l) LEFT JOIN h ON h.vec_id = o.vec_id AND h.l = l.l AND h.x = floor(px / (300::DOUBLE / pow(2, l.l)))::INT AND h.y = floor(py / (300::DOUBLE / pow(2, l.l)))::INT), "
    "leaf AS (SELECT vec_id, i, coalesce(min(l) FILTER (WHERE NOT splits), 6)::INT AS level FROM k GROUP BY ALL)"
)


def leaves(spark, d):
    rows = segment_rows(spark, d).withColumn("c", F.col("kmax") * F.col("len"))
    s = quadtree.nodes(rows, "vec_id")
    pts = fx.cubics(spark, d).select("vec_id", F.posexplode(F.expr("transform(filter(cmds, k -> k.c = 'C'), k -> named_struct('x', k.sx, 'y', k.sy))")).alias("i", "p"))
    joined = pts.join(s, "vec_id", "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<int>")))
    return joined.select("vec_id", "i", F.expr(quadtree.leaf_level("p.x", "p.y")).alias("level"))


@query("q5_leaf_lookup", f"WITH {_LEAF} SELECT vec_id, i::INT AS i, level FROM leaf")
def q5(spark, d):
    return leaves(spark, d)


@query("q12_level_histogram", f"WITH {_LEAF} SELECT level, count(*) AS n FROM leaf GROUP BY level")
def q12(spark, d):
    return quadtree.histogram(leaves(spark, d))


@query("c3_curvature", f"WITH {SAMPLED} SELECT vec_id, i::INT AS i, round(kmax, 4) AS kmax, round(kmean, 4) AS kmean FROM g")
def c3(spark, d):
    return segment_rows(spark, d).select("vec_id", "i", F.round("kmax", 4).alias("kmax"), F.round("kmean", 4).alias("kmean"))


@query("c5_tangents", f"WITH {CUBICS} SELECT vec_id, i::INT AS i, round(atan2(y1-y0, x1-x0), 6) AS t0, round(atan2(y3-y2, x3-x2), 6) AS t1 FROM s")
def c5(spark, d):
    return segment_rows(spark, d).select("vec_id", "i", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


@query("c6_arc_length", f"WITH {SAMPLED} SELECT vec_id, i::INT AS i, round(len, 5) AS len FROM q")
def c6(spark, d):
    return segment_rows(spark, d).select("vec_id", "i", F.round("len", 5).alias("len"))


_BOX = ", ".join(f"round({f}({_AT.format(a=a)}), 6) AS {f}_{a}" for f in ("min", "max") for a in ("x", "y"))


@query("c7_bezier_bbox", f"WITH {CUBICS} SELECT vec_id, i::INT AS i, {_BOX} FROM (SELECT *, j::DOUBLE / 49 AS t FROM s, range(50) AS r(j)) GROUP BY ALL")
def c7(spark, d):
    rows = fx.cubics(spark, d).select("vec_id", F.posexplode(F.expr("filter(cmds, k -> k.c = 'C')")).alias("i", "k"))
    from ..functions.sqlgen import let

    pts = let(curves.controls(), f"transform(sequence(0, 49), j -> named_struct('x', {curves.at('x', '(j / 49D)')}, 'y', {curves.at('y', '(j / 49D)')}))", "array<struct<x:double,y:double>>")
    rows = rows.withColumn("p", F.expr(pts))
    return rows.select("vec_id", "i", *[F.round(F.expr(f"array_{f}(transform(p, q -> q.{a}))"), 6).alias(f"{f}_{a}") for f in ("min", "max") for a in ("x", "y")])


@query("c9_line_descriptors", f"WITH {LINES}, m AS (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py FROM l WINDOW v AS (PARTITION BY doc_id ORDER BY n)) SELECT doc_id, (n - 1)::INT AS i, round(sqrt((x-px)*(x-px)+(y-py)*(y-py)), 6) AS len, round(CASE WHEN sqrt((x-px)*(x-px)+(y-py)*(y-py)) < 1e-12 THEN 0 ELSE atan2(y-py, x-px) END, 6) AS theta FROM m WHERE n > 1")
def c9(spark, d):
    rows = fx.polylines(spark, d).select("doc_id", F.posexplode(F.expr(f"transform(elements[0], k -> {curves.segment()})")).alias("i", "g")).filter("i > 0")
    return rows.select("doc_id", "i", F.round("g.len", 6).alias("len"), F.round("g.t0", 6).alias("theta"))


@query("c10_curvature_bin", f"WITH {SAMPLED} SELECT CASE WHEN kmax < 1e-6 THEN 0 ELSE least(floor(ln(1 + kmax * 100) / 5 * 16)::INT, 15) END AS bin, count(*) AS n FROM g GROUP BY 1")
def c10(spark, d):
    return segment_rows(spark, d).groupBy(F.expr(curves.curvature_bin("kmax")).alias("bin")).agg(F.count("*").alias("n"))


@query("c11_complexity", f"WITH {SAMPLED} SELECT vec_id, round(sum(kmax * len), 3) AS complexity FROM g JOIN q USING (vec_id, i) GROUP BY vec_id")
def c11(spark, d):
    rows = segment_rows(spark, d).select("vec_id", F.struct("kmax", "len").alias("g"))
    return rows.groupBy("vec_id").agg(F.round(F.sum(F.expr(curves.complexity("g"))), 3).alias("complexity"))


#: Continuity of polylines: no bend is G2, as lines have no curvature.
CONT = (
    LINES + ", m AS (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py FROM l WINDOW v AS (PARTITION BY doc_id ORDER BY n)), "
    "th AS (SELECT *, CASE WHEN sqrt((x-px)*(x-px)+(y-py)*(y-py)) < 1e-12 THEN 0 ELSE atan2(y-py, x-px) END AS t FROM m WHERE n > 1), "
    "ct AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY n) AS pt FROM th), "
    "lv AS (SELECT *, CASE WHEN pt IS NULL THEN NULL WHEN least(abs(pt - t), 2 * pi() - abs(pt - t)) > 0.1 THEN 0 ELSE 2 END AS level FROM ct)"
)


@query("c12_continuity", f"WITH {CONT} SELECT doc_id, (n - 1)::INT AS i, level::INT AS level FROM lv WHERE level IS NOT NULL")
def c12(spark, d):
    rows = fx.polylines(spark, d).select("doc_id", F.posexplode(F.expr(curves.analysed("elements[0]"))).alias("i", "u"))
    return rows.filter("u.level IS NOT NULL").select("doc_id", "i", "u.level")


@query("t1_l1_tokens", f"WITH {CONT} SELECT doc_id, '1,10,' || max({d_id('l.x', 'l.y')}) FILTER (WHERE l.n = 1) || coalesce(',' || string_agg('11,' || {d_id('l.x', 'l.y')} || CASE WHEN level IS NULL THEN '' ELSE ',' || (31 + level) END, ',' ORDER BY l.n) FILTER (WHERE l.n > 1), '') || ',2' AS t FROM l LEFT JOIN lv USING (doc_id, n) GROUP BY doc_id")
def t1(spark, d):
    return codec.l1(fx.polylines(spark, d)).select("doc_id", F.expr(TEXT).alias("t"))


@query("t4_lean_tokens", f"WITH {LINES}, {TOKENS} SELECT doc_id, t FROM lean")
def t4(spark, d):
    return fx.streams(spark, d).select("doc_id", F.expr(TEXT).alias("t"))


@query("f15_marker_filter", f"WITH {LINES}, {TOKENS} SELECT doc_id, t FROM lean")
def f15(spark, d):
    return codec.l1(fx.polylines(spark, d)).withColumn("token_ids", F.expr(tokens.lean_of("token_ids"))).select("doc_id", F.expr(TEXT).alias("t"))


@query("t7_token_counts", f"WITH {LINES} SELECT doc_id, (2 * count(*) + 2)::INT AS n_tokens, count(*)::INT AS n_commands FROM l GROUP BY doc_id")
def t7(spark, d):
    return codec.l1(fx.polylines(spark, d), lean=True).select("doc_id", F.size("token_ids").alias("n_tokens"), F.expr("size(elements[0])").alias("n_commands"))


@query("t19_symbols", f"WITH {VOCAB_SQL}, {LONG} SELECT doc_id, string_agg(symbol, ' ' ORDER BY pos) AS s FROM t JOIN y ON tok = token_id GROUP BY doc_id")
def t19(spark, d):
    return fx.streams(spark, d).select("doc_id", F.expr(f"array_join({tokens.symbols('token_ids')}, ' ')").alias("s"))


# What a part's drawing decodes to: its body in composite tokens, and its bare commands.
_X, _Y, _CX, _CY = "(x + tx)::DOUBLE", "(y + ty)::DOUBLE", "(cx + tx)::DOUBLE", "(cy + ty)::DOUBLE"
_BODY = (
    f"CASE kind WHEN 0 THEN '20,' || {d_id(_CX, _CY)} || ',' || {d_scalar('r')} WHEN 2 THEN CASE WHEN rx - ry < 5 THEN '20,' || {d_id(_CX, _CY)} || ',' || {d_scalar('(rx + ry) / 2.0::DOUBLE')} ELSE '21,' || {d_id(_CX, _CY)} || ',' || {d_scalar('rx')} || ',' || {d_scalar('ry')} END "
    f"ELSE '22,' || {d_id(_X, _Y)} || ',' || {d_scalar('w')} || ',' || {d_scalar('h')} END"
)


def drawn(spark, d):
    return codec.parsed(fx.drawings(spark, d))


@query("s1_parse_elements", f"WITH {PART} SELECT k::BIGINT AS doc_id, ['circle', 'rect', 'ellipse', 'path'][kind + 1] AS tag, 'g' || k AS gid, 'translate(' || tx || ' ' || ty || ')' AS transform, CASE kind WHEN 0 THEN cx || ',' || cy || ',' || r WHEN 1 THEN x || ',' || y || ',' || w || ',' || h || ',0,0' WHEN 2 THEN cx || ',' || cy || ',' || rx || ',' || ry ELSE '' END AS v FROM p")
def s1(spark, d):
    rows = source.parse(fx.drawings(spark, d)).select("doc_id", F.expr("doc.elements[0]").alias("e"))
    return rows.select("doc_id", "e.tag", "e.gid", F.expr("e.transforms[0]").alias("transform"), F.expr("array_join(transform(e.v, x -> cast(cast(x AS INT) AS STRING)), ',')").alias("v"))


@query("g1_path_lex", f"WITH {PART} SELECT k::BIGINT AS doc_id, 'm' || x || ',' || y || ' h' || w || ' v' || h || ' h-' || w || ' z' AS lexed FROM p")
def g1(spark, d):
    p = fx.table(spark, d, "part").selectExpr(*[f"cast({v} AS INT) AS {n}" for n, v in fx.PART.items()])
    rows = p.select(F.col("k").cast("long").alias("doc_id"), F.expr("concat('m', x, ',', y, 'h', w, ' v', h, 'h-', w, 'z')").alias("d"))
    return rows.select("doc_id", F.expr(f"array_join(transform({path.lexed('d')}, t -> concat(t.c, array_join(transform(t.n, v -> cast(cast(v AS INT) AS STRING)), ','))), ' ')").alias("lexed"))


@query("g3_resolve", f"WITH {PART} SELECT k::BIGINT AS doc_id, 'M' || x || ',' || y || ' H' || (x + w) || ',' || y || ' V' || (x + w) || ',' || (y + h) || ' H' || x || ',' || (y + h) || ' Z' AS resolved, x::DOUBLE AS ex, y::DOUBLE AS ey FROM p")
def g3(spark, d):
    p = fx.table(spark, d, "part").selectExpr(*[f"cast({v} AS INT) AS {n}" for n, v in fx.PART.items()])
    rows = p.select(F.col("k").cast("long").alias("doc_id"), F.expr("concat('m', x, ',', y, 'h', w, ' v', h, 'h-', w, 'z')").alias("d")).withColumn("c", F.expr(path.parsed("d")))
    return rows.select("doc_id", F.expr("array_join(transform(c, t -> concat(t.c, array_join(transform(t.p, v -> cast(cast(v AS INT) AS STRING)), ','))), ' ')").alias("resolved"), F.expr("c[size(c) - 1].ex").alias("ex"), F.expr("c[size(c) - 1].ey").alias("ey"))


@query("g4_shape_points", f"WITH {PART} SELECT k::BIGINT AS doc_id, [13, 4, 13, 4][kind + 1]::INT AS n_points, CASE WHEN kind IN (0, 2) THEN (cx + tx + CASE kind WHEN 0 THEN r ELSE rx END)::DOUBLE ELSE (x + tx)::DOUBLE END AS x0, CASE WHEN kind IN (0, 2) THEN (cy + ty)::DOUBLE ELSE (y + ty)::DOUBLE END AS y0 FROM p")
def g4(spark, d):
    rows = drawn(spark, d).withColumn("p", F.expr(f"flatten(transform(elements, e -> {path.all_points('e')}))"))
    return rows.select("doc_id", F.size("p").alias("n_points"), F.expr("p[0].x").alias("x0"), F.expr("p[0].y").alias("y0"))


@query("g9_transform", f"WITH {PART} SELECT k::BIGINT AS doc_id, round(2 * cos(radians(tx * 30)), 6) AS a, round(2 * sin(radians(tx * 30)), 6) AS b, round(-(1 + ty) * sin(radians(tx * 30)), 6) + 0.0 AS c, round((1 + ty) * cos(radians(tx * 30)), 6) AS d, (x + 5)::DOUBLE AS e, (y + 7)::DOUBLE AS f FROM p")
def g9(spark, d):
    p = fx.table(spark, d, "part").selectExpr(*[f"cast({v} AS INT) AS {n}" for n, v in fx.PART.items()])
    rows = p.withColumn("m", F.expr(path.transform_matrix("array(concat('translate(', x, ',', y, ')'), concat('matrix(1 0 0 1 5 7) rotate(', tx * 30, ') scale(2, ', 1 + ty, ')'))")))
    return rows.select(F.col("k").cast("long").alias("doc_id"), *[F.round(F.expr(f"m.{n}"), 6).alias(n) for n in path.MATRIX])


@query("g11_viewbox", "SELECT s_suppkey, round(300::DOUBLE / greatest(10 + s_suppkey % 90, 20 + s_suppkey % 50), 9) AS scale, round((300 - (10 + s_suppkey % 90) * (300::DOUBLE / greatest(10 + s_suppkey % 90, 20 + s_suppkey % 50))) / 2 - 3 * (300::DOUBLE / greatest(10 + s_suppkey % 90, 20 + s_suppkey % 50)), 6) AS e FROM supplier")
def g11(spark, d):
    s = fx.table(spark, d, "supplier").withColumn("box", F.expr("array(3D, 4D, cast(10 + s_suppkey % 90 AS DOUBLE), cast(20 + s_suppkey % 50 AS DOUBLE))")).withColumn("m", F.expr(path.viewbox_matrix("box", ids.CANVAS)))
    return s.select("s_suppkey", F.round("m.a", 9).alias("scale"), F.round("m.e", 6).alias("e"))


@query("g13_arc_flatten", "SELECT s_suppkey, [1, 1, 4, 1][s_suppkey % 4 + 1]::INT AS n, round(100 + (10 + s_suppkey % 50) * CASE WHEN s_suppkey % 4 IN (1, 2) THEN 0.8660254037844386::DOUBLE ELSE 1 END, 6) AS ex, 'ok' AS on_circle FROM supplier")
def g13(spark, d):
    # About (100, 100): a quarter turn (0), 60 degrees (1), 300 the other way (2); and an arc of no radius (3).
    r = "(10 + s_suppkey % 50)"
    end = f"concat({r} * 0.8660254037844386D, ' ', {r} / 2D)"
    text = f"CASE s_suppkey % 4 WHEN 0 THEN concat('M100 ', 100 - {r}, 'A', {r}, ' ', {r}, ' 0 01', 100 + {r}, ' 100') WHEN 3 THEN concat('M100 100A0 5 0 0 1 ', 100 + {r}, ' 100') ELSE concat('M100 ', 100 - {r}, 'a', {r}, ',', {r}, ' 30 ', s_suppkey % 4 - 1, ',', 2 - s_suppkey % 4, {end}) END"
    rows = fx.table(spark, d, "supplier").withColumn("c", F.expr(path.without_arcs(path.parsed(text))))
    near = lambda x, y, most: f"abs(sqrt(power({x} - 100, 2) + power({y} - 100, 2)) - {r}) <= {most}"
    on = f"s_suppkey % 4 = 3 OR forall(slice(c, 2, size(c) - 1), k -> {near('k.ex', 'k.ey', '1e-6')} AND {near('k.p[0]', 'k.p[1]', f'0.2 * {r}')})"
    return rows.select("s_suppkey", (F.size("c") - 1).alias("n"), F.round(F.expr("c[size(c) - 1].ex"), 6).alias("ex"), F.expr(f"IF({on}, 'ok', 'off')").alias("on_circle"))


@query("g15_path_text", f"WITH {LINES} SELECT doc_id, string_agg(CASE WHEN n = 1 THEN 'M ' ELSE 'L ' END || x::INT || ' ' || (floor(y))::INT, ' ' ORDER BY n) AS d FROM l GROUP BY doc_id")
def g15(spark, d):
    whole = "transform(elements[0], k -> named_struct('c', k.c, 'p', array(k.p[0], cast(floor(k.p[1]) AS DOUBLE)), 'sx', k.sx, 'sy', k.sy, 'ex', k.ex, 'ey', k.ey))"
    return fx.polylines(spark, d).withColumn("w", F.expr(whole)).select("doc_id", F.expr(path.path_text("w")).alias("d"))


#: The points of every drawing, in the order of its commands: of a circle four curves with their control points.
_UNIT = "[{'u': 1, 'v': 0}, {'u': 1, 'v': c}, {'u': c, 'v': 1}, {'u': 0, 'v': 1}, {'u': -c, 'v': 1}, {'u': -1, 'v': c}, {'u': -1, 'v': 0}, {'u': -1, 'v': -c}, {'u': -c, 'v': -1}, {'u': 0, 'v': -1}, {'u': c, 'v': -1}, {'u': 1, 'v': -c}, {'u': 1, 'v': 0}]"
_CORNER = "[{'u': 0, 'v': 0}, {'u': 1, 'v': 0}, {'u': 1, 'v': 1}, {'u': 0, 'v': 1}]"
_DRAWN = (
    f"{PART}, o AS (SELECT k::BIGINT AS doc_id, kind IN (0, 2) AS oval, CASE WHEN kind IN (0, 2) THEN cx + tx ELSE x + tx END::DOUBLE AS px, CASE WHEN kind IN (0, 2) THEN cy + ty ELSE y + ty END::DOUBLE AS py, "
    "CASE kind WHEN 0 THEN r WHEN 2 THEN rx ELSE w END::DOUBLE AS sx, CASE kind WHEN 0 THEN r WHEN 2 THEN ry ELSE h END::DOUBLE AS sy, 0.5522847498::DOUBLE AS c FROM p), "
    f"l AS (SELECT doc_id, oval, px, py, sx, sy, CASE WHEN oval THEN {_UNIT} ELSE list_transform({_CORNER}, lambda z: {{'u': z.u::DOUBLE, 'v': z.v::DOUBLE}}) END AS f FROM o), "
    "c AS (SELECT doc_id, oval, i, px + sx * f[i].u AS x, py + sy * f[i].v AS y FROM l, range(1, 14) r(i) WHERE i <= len(f))"
)
_NUM3 = lambda v: f"regexp_replace(printf('%.3f', {v}), '\\.?0+$', '')"


@query(
    "g16_normalized_svg",
    f"WITH {_DRAWN}, t AS (SELECT doc_id, string_agg(CASE WHEN i = 1 THEN 'M ' WHEN NOT oval THEN 'L ' WHEN i % 3 = 2 THEN 'C ' ELSE '' END || {_NUM3('x')} || ' ' || {_NUM3('y')}, ' ' ORDER BY i) AS d FROM c GROUP BY doc_id) "
    "SELECT doc_id, '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"300\" height=\"300\" viewBox=\"0 0 300 300\">' || chr(10) || '  <path d=\"' || d || ' Z\" fill=\"none\" stroke=\"black\" stroke-width=\"1.0\"/>' || chr(10) || '</svg>' AS truth FROM t",
)
def g16(spark, d):
    return codec.normalized_svg(drawn(spark, d)).select("doc_id", "truth")


@query("g17_bbox", f"WITH {LINES} SELECT doc_id, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM l GROUP BY doc_id")
def g17(spark, d):
    return fx.polylines(spark, d).withColumn("b", F.expr(path.bbox("elements[0]"))).select("doc_id", *[F.round(F.expr(f"b.{n}"), 6).alias(n) for n in ("x0", "y0", "x1", "y1")])


@query("r1_subpaths", f"WITH {PART} SELECT k::BIGINT AS doc_id, 0 AS a, CASE kind WHEN 0 THEN 5 WHEN 2 THEN 5 ELSE 4 END AS b FROM p")
def r1(spark, d):
    rows = drawn(spark, d).select("doc_id", F.explode(F.expr(f"flatten(transform(elements, e -> {shapes.subpaths('e')}))")).alias("z"))
    return rows.select("doc_id", "z.a", "z.b")


@query("r3_shapes", f"WITH {PART} SELECT k::BIGINT AS doc_id, CASE kind WHEN 0 THEN 'circle' WHEN 2 THEN CASE WHEN rx - ry < 5 THEN 'circle' ELSE 'ellipse' END ELSE 'rect' END AS shape, CASE kind WHEN 0 THEN (cx+tx) || ',' || (cy+ty) || ',' || r WHEN 2 THEN (cx+tx) || ',' || (cy+ty) || ',' || rx || ',' || ry ELSE (x+tx) || ',' || (y+ty) || ',' || w || ',' || h END AS p FROM p")
def r3(spark, d):
    rows = drawn(spark, d).select("doc_id", F.explode(F.expr(f"flatten(transform(elements, e -> {shapes.detected('e')}))")).alias("x"))
    return rows.select("doc_id", "x.shape", F.expr("array_join(transform(x.p, v -> cast(cast(round(v) AS INT) AS STRING)), ',')").alias("p"))


@query("t9_composite", f"WITH {PART} SELECT k::BIGINT AS doc_id, '1,' || {_BODY} || ',2' AS t FROM p")
def t9(spark, d):
    rows = drawn(spark, d).withColumn("token_ids", F.expr(tokens.bracketed(f"transform(elements, e -> {shapes.composite('e')})")))
    return rows.select("doc_id", F.expr(TEXT).alias("t"))


@query("t12_element_info", f"WITH {PART} SELECT k::BIGINT AS doc_id, CASE kind WHEN 0 THEN cx + tx WHEN 2 THEN cx + tx ELSE x + tx + w / 2.0 END::DOUBLE AS cx, CASE kind WHEN 0 THEN 2 * r WHEN 2 THEN 2 * rx ELSE w END::DOUBLE AS w FROM p")
def t12(spark, d):
    rows = drawn(spark, d).select("doc_id", F.expr(shapes.info("elements[0]", "0")).alias("i"))
    return rows.select("doc_id", F.round("i.cx", 6).alias("cx"), F.round("i.w", 6).alias("w"))


def laid_out(spark, d):
    return codec.parsed(fx.layouts(spark, d)).withColumn("info", F.expr(f"transform(elements, (e, n) -> {shapes.info('e', 'n')})"))


@query("r7_relations", "WITH n AS (SELECT n_nationkey::BIGINT AS doc_id, (n_nationkey % 5 + 2) AS n, 50 + n_nationkey * 5 AS cy FROM nation), x AS (SELECT *, array_to_string(range(n), ',') AS idx FROM n) SELECT doc_id, 'ALIGN_CENTER_H' AS kind, idx, cy::DOUBLE AS axis, NULL::DOUBLE AS spacing FROM x UNION ALL SELECT doc_id, 'EQUAL_SPACE_H', idx, NULL, 40 FROM x WHERE n >= 3 UNION ALL SELECT doc_id, 'SYM_REFLECT_X', idx, 30 + 20 * (n - 1), NULL FROM x UNION ALL SELECT doc_id, 'SYM_REFLECT_Y', idx, cy, NULL FROM x UNION ALL SELECT doc_id, 'EQUAL_SIZE', idx, NULL, NULL FROM x")
def r7(spark, d):
    rows = laid_out(spark, d).select("doc_id", F.explode(F.expr(relations.relations("info"))).alias("r"))
    return rows.select("doc_id", "r.kind", F.expr("array_join(transform(r.idx, v -> cast(v AS STRING)), ',')").alias("idx"), F.round("r.axis", 6).alias("axis"), F.round("r.spacing", 6).alias("spacing"))


@query("t15_repeat_groups", "SELECT n_nationkey::BIGINT AS doc_id, (n_nationkey % 5 + 2)::INT AS n, 40::DOUBLE AS spacing, (50 + n_nationkey * 5)::DOUBLE AS axis FROM nation WHERE n_nationkey % 5 + 2 >= 3")
def t15(spark, d):
    rows = laid_out(spark, d).withColumn("r", F.expr(relations.relations("info"))).select("doc_id", F.explode(F.expr(relations.repeat_groups("r"))).alias("g"))
    return rows.select("doc_id", F.expr("size(g.idx)").alias("n"), F.round("g.spacing", 6).alias("spacing"), F.round("g.axis", 6).alias("axis"))


_ANCHOR = f"'20,' || {d_id('30::DOUBLE', 'cy::DOUBLE')} || ',' || {d_scalar('r')}"


@query("t11_spatial", f"WITH n AS (SELECT n_nationkey::BIGINT AS doc_id, (n_nationkey % 5 + 2) AS n, 50 + n_nationkey * 5 AS cy, 8 + n_nationkey % 7 AS r FROM nation) SELECT doc_id, CASE WHEN n = 2 THEN '1,' || {_ANCHOR} || ',62,' || {d_scalar('50')} || ',2' ELSE '1,' || {_ANCHOR} || ',66,60,' || {d_scalar('cy')} || ',64,' || {d_scalar('40')} || ',' || CASE n WHEN 3 THEN '67' WHEN 4 THEN '68' WHEN 5 THEN '69' ELSE '70,' || (1465 + 5 * 64) END || ',2' END AS t FROM n")
def t11(spark, d):
    rows = laid_out(spark, d).withColumn("b", F.expr(f"transform(elements, e -> {shapes.composite('e')})")).withColumn("token_ids", F.expr(relations.stream("b", "info")))
    return rows.select("doc_id", F.expr(TEXT).alias("t"))


_CX0, _SP, _AX = f"printf('%.2f', {d_centre(d_q('30::DOUBLE'))})::DOUBLE", "546::DOUBLE / 4095 * 300", "682::DOUBLE / 4095 * 300"  # 40 and 50, as codes decode


@query(
    "k6_spatial_decode",
    f"WITH n AS (SELECT n_nationkey::BIGINT AS doc_id, (n_nationkey % 5 + 2) AS n FROM nation) SELECT doc_id, string_agg(CASE WHEN i = 0 THEN {d_trim(d_centre(d_q('30::DOUBLE')), 2)} WHEN n = 2 THEN {d_trim(f'2 * {_AX} - {_CX0}')} ELSE {d_trim(f'{_CX0} + {_SP} * i')} END, ' ' ORDER BY i) AS centres FROM n, range(6) r(i) WHERE i < n GROUP BY doc_id",
)
def k6(spark, d):
    rows = laid_out(spark, d).withColumn("b", F.expr(f"transform(elements, e -> {shapes.composite('e')})")).withColumn("token_ids", F.expr(relations.stream("b", "info")))
    out = codec.detokenize(rows.select("doc_id", "token_ids", F.lit(ids.TOKENIZER_VERSION).alias("tokenizer_version")))
    return out.select("doc_id", F.expr("array_join(regexp_extract_all(svg, '<circle cx=\"([^\"]*)\"', 1), ' ')").alias("centres"))


_PAIRS = LONG + ", w AS (SELECT tok AS a, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM t), c AS (SELECT a, b, count(*) AS n FROM w WHERE b IS NOT NULL AND a NOT IN (1, 2, 3) AND b NOT IN (1, 2, 3) GROUP BY ALL)"


@query("b1_pair_counts", f"WITH {_PAIRS} SELECT a, b, n FROM c")
def b1(spark, d):
    return bpe.pair_counts(fx.streams(spark, d))


@query("b2_top_pair", f"WITH {_PAIRS} SELECT a, b, n FROM c ORDER BY n DESC, a, b LIMIT 1")
def b2(spark, d):
    return bpe.best_pair(bpe.pair_counts(fx.streams(spark, d)))


#: All lines to one cell become one id: the pair (11, 1465 + 64 * 63) never overlaps itself.
@query("b3_apply_merge", f"WITH {LINES}, {TOKENS} SELECT doc_id, replace(t || ',', '11,5497,', '5561,') AS t FROM lean")
def b3(spark, d):
    rows = fx.streams(spark, d).withColumn("token_ids", F.expr(bpe.merged("token_ids", 11, 5497, 5561)))
    return rows.select("doc_id", F.expr(f"concat({TEXT}, ',')").alias("t"))


MERGES = [[11, 5497, 5561], [5561, 5561, 5562], [10, 5497, 5563]]


@query("b5_encode", f"WITH {LINES}, {TOKENS}, a AS (SELECT doc_id, replace(t || ',', '11,5497,', '5561,') AS t FROM lean), b AS (SELECT doc_id, replace(t, '5561,5561,', '5562,') AS t FROM a) SELECT doc_id, replace(t, ',10,5497,', ',5563,') AS t FROM b")
def b5(spark, d):
    return bpe.encode(fx.streams(spark, d), MERGES).select("doc_id", F.expr(f"concat({TEXT}, ',')").alias("t"))


@query("b6_decode", f"WITH {LINES}, {TOKENS} SELECT doc_id, t FROM lean")
def b6(spark, d):
    return bpe.decode(bpe.encode(fx.streams(spark, d), MERGES), MERGES).select("doc_id", F.expr(TEXT).alias("t"))


@query("b8_lossless", f"WITH {LINES}, m AS (SELECT count(*) AS n, sum(2 * c + 2) AS tokens FROM (SELECT doc_id, count(*) AS c FROM l GROUP BY doc_id)) SELECT n AS streams, tokens::BIGINT AS l1_tokens, true AS lossless FROM m")
def b8(spark, d):
    rows = fx.streams(spark, d)
    both = bpe.encode(rows.withColumn("l1", F.col("token_ids")), MERGES).withColumn("back", F.expr(bpe.expanded("token_ids", MERGES)))
    return both.agg(F.count("*").alias("streams"), F.sum(F.size("l1")).alias("l1_tokens"), F.bool_and(F.expr("back = l1")).alias("lossless"))


#: Streams broken in a known way: by the id modulo 5.
BROKEN = "CASE doc_id % 5 WHEN 0 THEN token_ids WHEN 1 THEN slice(token_ids, 2, size(token_ids) - 1) WHEN 2 THEN slice(token_ids, 1, size(token_ids) - 1) WHEN 3 THEN concat(slice(token_ids, 1, size(token_ids) - 2), array(2)) ELSE concat(array(1, 30), slice(token_ids, 2, size(token_ids) - 1)) END"


@query("a4_validate", f"WITH {LINES}, s AS (SELECT doc_id, count(*)::INT AS c FROM l GROUP BY doc_id) SELECT doc_id, doc_id % 5 = 0 AS valid, (CASE doc_id % 5 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 2 * c WHEN 3 THEN 2 * c ELSE 1 END)::INT AS position, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'missing BOS' WHEN 2 THEN 'missing EOS' WHEN 3 THEN 'EOS while args pending' ELSE 'token 30 not allowed in state (pending=0,state=boundary)' END AS reason FROM s")
def a4(spark, d):
    rows = fx.streams(spark, d).withColumn("token_ids", F.expr(BROKEN)).withColumn("v", F.expr(grammar.validated("token_ids")))
    return rows.select("doc_id", "v.valid", "v.position", "v.reason")


@query("a5_repair", f"WITH {LINES}, {TOKENS}, s AS (SELECT doc_id, max(n) AS c FROM l GROUP BY doc_id) SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN regexp_replace(t, '1[01],[0-9]+,2$', '2') ELSE t END AS t FROM lean")
def a5(spark, d):
    rows = fx.streams(spark, d).withColumn("token_ids", F.expr(BROKEN)).withColumn("token_ids", F.expr(grammar.repaired("token_ids")))
    return rows.select("doc_id", F.expr(TEXT).alias("t"))


@query("a3_mask", "SELECT p::INT AS prefix, n::INT AS n_allowed FROM (VALUES (0, 25), (1, 5461), (2, 45), (3, 41), (4, 25), (5, 25)) v(p, n)")
def a3(spark, d):
    rows = spark.createDataFrame([(0, [1]), (1, [1, 10]), (2, [1, 10, 140]), (3, [1, 10, 140, 31]), (4, [1, 10, 140, 42]), (5, [1, 20, 140, 2000])], "prefix int, t array<int>")
    return rows.select("prefix", F.expr(f"size(filter({grammar.mask('t')}, v -> v))").alias("n_allowed"))


@query("a3_stream_masks", f"WITH {LONG}, n AS (SELECT doc_id, max(pos) AS n FROM t GROUP BY doc_id) SELECT doc_id, (1 + doc_id % n)::INT AS size, (CASE WHEN doc_id % n = 0 THEN 25 WHEN doc_id % n % 2 = 1 THEN 5461 ELSE 45 END)::INT AS n_allowed FROM n")
def a3_streams(spark, d):
    """What may follow a prefix of every order's stream."""
    rows = fx.streams(spark, d).withColumn("size", F.expr("cast(1 + doc_id % (size(token_ids) - 1) AS INT)")).withColumn("t", F.expr("slice(token_ids, 1, size)"))
    return sampling.with_n_allowed(rows.select("doc_id", "size", "t"), "t").select("doc_id", "size", "n_allowed")


@query("k1_segments", f"WITH {LINES} SELECT doc_id, (n - 1)::INT AS seg, CASE WHEN n = 1 THEN 10 ELSE 11 END AS command, {d_id('x', 'y')} AS coord FROM l")
def k1(spark, d):
    rows = fx.streams(spark, d).select("doc_id", F.posexplode(F.expr(decode.groups("token_ids"))).alias("seg", "g"))
    return rows.select("doc_id", "seg", F.col("g.c").alias("command"), F.expr("g.v[0]").alias("coord"))


_D = f"string_agg(CASE WHEN n = 1 THEN 'M ' ELSE 'L ' END || {d_trim(d_centre(d_q('x')))} || ' ' || {d_trim(d_centre(d_q('y')))}, ' ' ORDER BY n)"


@query("k3_path_d", f"WITH {LINES} SELECT doc_id, {_D} AS d FROM l GROUP BY doc_id")
def k3(spark, d):
    return fx.streams(spark, d).select("doc_id", F.expr(decode.path_text("token_ids")).alias("d"))


@query("k8_svg_document", f"WITH {LINES} SELECT doc_id, '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"300\" height=\"300\" viewBox=\"0 0 300 300\">' || chr(10) || '  <path d=\"' || {_D} || '\" fill=\"none\" stroke=\"black\" stroke-width=\"1\"/>' || chr(10) || '</svg>' AS svg FROM l GROUP BY doc_id")
def k8(spark, d):
    return fx.streams(spark, d).select("doc_id", F.expr(decode.document(decode.element_list("token_ids"))).alias("svg"))


def _d_deq(v: str) -> str:
    return d_trim(f"round_even(greatest(0, least({v}, 300))::DOUBLE / 300 * 4095, 0) / 4095 * 300", 2)


@query("k5_composite_decode", f"WITH {PART}, q AS (SELECT *, {d_trim(d_centre(d_q(_CX)), 2)} AS a, {d_trim(d_centre(d_q(_CY)), 2)} AS b, {d_trim(d_centre(d_q(_X)), 2)} AS c, {d_trim(d_centre(d_q(_Y)), 2)} AS d FROM p) SELECT k::BIGINT AS doc_id, CASE kind WHEN 0 THEN '<circle cx=\"' || a || '\" cy=\"' || b || '\" r=\"' || {_d_deq('r')} WHEN 2 THEN '<ellipse cx=\"' || a || '\" cy=\"' || b || '\" rx=\"' || {_d_deq('rx')} || '\" ry=\"' || {_d_deq('ry')} ELSE '<rect x=\"' || c || '\" y=\"' || d || '\" width=\"' || {_d_deq('w')} || '\" height=\"' || {_d_deq('h')} END || '\" fill=\"none\" stroke=\"black\" stroke-width=\"1\"/>' AS element FROM q")
def k5(spark, d):
    rows = drawn(spark, d).withColumn("token_ids", F.expr(tokens.bracketed(f"transform(elements, e -> {shapes.composite('e')})")))
    return rows.select("doc_id", F.expr(f"({decode.element_list('token_ids')})[0]").alias("element"))


@query("k9_extract_coords", f"WITH {LINES} SELECT doc_id, (n - 1)::INT AS pos, {d_centre(d_q('x'))} AS x, {d_centre(d_q('y'))} AS y FROM l")
def k9(spark, d):
    pts = f"transform(filter(token_ids, t -> {ids.is_coord('t')}), t -> named_struct('x', {ids.x_of('t')}, 'y', {ids.y_of('t')}))"
    return fx.streams(spark, d).select("doc_id", F.posexplode(F.expr(pts)).alias("pos", "p")).select("doc_id", "pos", "p.x", "p.y")


_LERR = f"sqrt(pow(x - {d_centre(d_q('x'))}, 2) + pow(y - {d_centre(d_q('y'))}, 2))"


def line_errors(spark, d):
    rows = codec.l1(fx.polylines(spark, d), lean=True)
    recon = f"transform(filter(token_ids, t -> {ids.is_coord('t')}), t -> named_struct('x', {ids.x_of('t')}, 'y', {ids.y_of('t')}))"
    return rows.withColumn("recon", F.expr(recon)).withColumn("errs", F.expr(evaluation.errors("pts", "recon")))


@query("k10_measure_fidelity", f"WITH {LINES}, e AS (SELECT doc_id, {_LERR} AS e FROM l) SELECT doc_id, round(max(e), 6) AS max_error, round(avg(e), 6) AS mean_error, round(sqrt(avg(e * e)), 6) AS rms_error, count(*)::INT AS n_points FROM e GROUP BY doc_id")
def k10(spark, d):
    return line_errors(spark, d).select("doc_id", F.round(F.array_max("errs"), 6).alias("max_error"), F.round(F.expr("aggregate(errs, 0D, (a, e) -> a + e) / size(errs)"), 6).alias("mean_error"), F.round(F.expr("sqrt(aggregate(errs, 0D, (a, e) -> a + e * e) / size(errs))"), 6).alias("rms_error"), F.size("pts").alias("n_points"))


@query("k11_payload", f"WITH {LINES}, s AS (SELECT doc_id, count(*)::INT AS c FROM l GROUP BY doc_id) SELECT doc_id, doc_id % 5 = 0 AS valid, doc_id % 5 <> 0 AS repaired, (2 * c + 2 + [0, -1, -1, -1, 1][doc_id % 5 + 1])::INT AS n_tokens, CASE WHEN doc_id % 5 = 3 AND c = 1 THEN 0 ELSE 1.7934 END::DOUBLE AS coord_mean_px FROM s")
def k11(spark, d):
    rows = fx.streams(spark, d).withColumn("token_ids", F.expr(BROKEN)).withColumn("tokenizer_version", F.lit(ids.TOKENIZER_VERSION))
    return codec.detokenize(rows).select("doc_id", "valid", "repaired", "n_tokens", F.col("fidelity.coord_mean_px").alias("coord_mean_px"))


@query("e2_point_errors", f"WITH {LINES} SELECT doc_id, (n - 1)::INT AS pos, round(CASE WHEN doc_id % 4 = 0 AND n = 1 THEN 300 * sqrt(2) ELSE {_LERR} END, 6) AS err FROM l")
def e2(spark, d):
    rows = codec.l1(fx.polylines(spark, d), lean=True)
    truth = rows.select("doc_id", F.posexplode("pts").alias("pos", "p")).select("doc_id", "pos", "p.x", "p.y")
    pts = f"transform(filter(token_ids, t -> {ids.is_coord('t')}), t -> named_struct('x', {ids.x_of('t')}, 'y', {ids.y_of('t')}))"
    recon = rows.select("doc_id", F.posexplode(F.expr(pts)).alias("pos", "p")).select("doc_id", "pos", "p.x", "p.y").filter("NOT (doc_id % 4 = 0 AND pos = 0)")
    return evaluation.point_errors(truth, recon, ["doc_id"]).select("doc_id", "pos", F.round("err", 6).alias("err"))


#: The truth is text of three decimals, what is decoded text of one.
_DEC = lambda v: f"printf('%.1f', {d_centre(d_q(v))})::DOUBLE"
_TEXT_ERR = f"{_DRAWN}, e AS (SELECT doc_id, sqrt(pow(printf('%.3f', x)::DOUBLE - {_DEC('x')}, 2) + pow(printf('%.3f', y)::DOUBLE - {_DEC('y')}, 2)) AS e FROM c)"


@query("e3_scene_scores", f"WITH {_TEXT_ERR} SELECT doc_id, round(avg(e), 6) AS attr_mean_err, round(max(e), 6) AS attr_max_err, true AS count_match FROM e GROUP BY doc_id")
def e3(spark, d):
    scores = evaluation.builtin_eval(fx.drawings(spark, d))
    return scores.select("doc_id", F.round("attr_mean_err", 6).alias("attr_mean_err"), F.round("attr_max_err", 6).alias("attr_max_err"), "count_match")


@query("e4_summary", f"WITH {_TEXT_ERR}, m AS (SELECT doc_id, avg(e) AS me, max(e) AS mx FROM e GROUP BY doc_id) SELECT count(*) AS scenes, round(avg(me), 4) AS attr_mean_err, round(max(mx), 4) AS attr_max_err, 1::DOUBLE AS count_acc, (SELECT count(*) FROM e) AS coords_measured, (SELECT round(quantile_cont(e, 0.5), 4) FROM e) AS coord_err_p50, (SELECT round(quantile_cont(e, 0.99), 4) FROM e) AS coord_err_p99, (SELECT round(avg((e > 2)::INT), 4) FROM e) AS perceptible_err_rate FROM m")
def e4(spark, d):
    scores = evaluation.summary(evaluation.builtin_eval(fx.drawings(spark, d)))
    return scores.select("scenes", "attr_mean_err", "attr_max_err", "count_acc", "coords_measured", "coord_err_p50", "coord_err_p99", "perceptible_err_rate")


@query("e7_restyle", "SELECT page_id, md5(CASE WHEN page_id % 2 = 0 THEN replace(html || '<path d=\"M1 1\"/>', '<path ', '<path stroke-width=\"3.0\" ') ELSE html || '<g stroke-width=\"3.0\"/><path stroke-width=\"3.0\" d=\"M1 1\"/>' END) AS styled FROM pages")
def e7(spark, d):
    svg = "concat(html, IF(page_id % 2 = 0, '<path d=\"M1 1\"/>', '<g stroke-width=\"1\"/><path stroke-width=\"7\" d=\"M1 1\"/>'))"
    return fx.table(spark, d, "pages").withColumn("s", F.expr(svg)).select("page_id", F.md5(F.expr(evaluation.restyled("s", 3.0))).alias("styled"))


@query("e8_values", f"WITH {PART}, v AS (SELECT k::BIGINT AS doc_id, 'circle' AS tag, unnest(['cx', 'cy', 'r']) AS attr, 1 AS n, unnest([cx, cy, r])::DOUBLE AS v FROM p WHERE kind = 0 UNION ALL SELECT k, 'rect', unnest(['x', 'y', 'width', 'height']), 1, unnest([x, y, w, h]) FROM p WHERE kind = 1 UNION ALL SELECT k, 'ellipse', unnest(['cx', 'cy', 'rx', 'ry']), 1, unnest([cx, cy, rx, ry]) FROM p WHERE kind = 2 UNION ALL SELECT k, 'path', 'd', unnest([1, 2, 3, 4, 5]), unnest([x, y, w, h, -w]) FROM p WHERE kind = 3) SELECT doc_id, tag, attr, n::INT AS n, v FROM v")
def e8(spark, d):
    return evaluation.values(fx.drawings(spark, d), "svg").select("doc_id", "tag", "attr", F.col("n").cast("int"), "v")


#: What is held against the drawings: kinds 0 to 2 moved by 1 to 3, of every seventh part nothing.
_AGAIN = "IF(k % 7 = 0, '<svg/>', replace(replace(replace(svg, concat(' cx=\"', cx, '\"'), concat(' cx=\"', cx + k % 3 + 1, '\"')), concat('x=\"', x, '\" y'), concat('x=\"', x + k % 3 + 1, '\" y')), concat('m', x, ','), concat('m', x + 5, ',')))"
_MOVED = f"WITH {PART}, v AS (SELECT k::BIGINT AS doc_id, k % 7 = 0 AS gone, CASE kind WHEN 3 THEN 5 ELSE k % 3 + 1 END::DOUBLE AS moved, CASE kind WHEN 0 THEN 3 WHEN 3 THEN 5 ELSE 4 END AS n, kind FROM p), f AS (SELECT doc_id, CASE WHEN gone THEN 'infinity'::DOUBLE ELSE moved END AS attr_max_err, CASE WHEN gone THEN 'infinity'::DOUBLE ELSE round(moved / n, 6) END AS attr_mean_err, kind = 3 OR NOT gone AS count_match FROM v)"


@query("e9_value_fidelity", f"{_MOVED} SELECT * FROM f")
def e9(spark, d):
    numbers = fx.table(spark, d, "part").selectExpr(*[f"cast({v} AS INT) AS {n}" for n, v in fx.PART.items()]).withColumn("doc_id", F.col("k").cast("long"))
    rows = fx.drawings(spark, d).join(numbers, "doc_id").withColumn("again", F.expr(_AGAIN))
    out = evaluation.value_fidelity(rows.select("doc_id", "svg", "again"), "svg", "again")
    return out.select("doc_id", "attr_max_err", F.round("attr_mean_err", 6).alias("attr_mean_err"), "count_match")


@query("e10_value_summary", f"{_MOVED} SELECT count(*) AS scenes, round(max(attr_max_err), 6) AS attr_max_err, round(avg(attr_mean_err), 6) AS attr_mean_err, round(avg(count_match::INT), 6) AS count_acc FROM f WHERE attr_max_err < 'infinity'::DOUBLE")
def e10(spark, d):
    """Of the drawings that something pairs with."""
    return evaluation.value_summary(e9(spark, d).filter("attr_max_err < double('infinity')"))


@query("e13_corpus_gates", f"WITH {_DRAWN}, c2 AS (SELECT doc_id, sqrt(pow(x - {d_centre(d_q('x'))}, 2) + pow(y - {d_centre(d_q('y'))}, 2)) AS e FROM c), m AS (SELECT doc_id, avg(e) AS me, max(e) AS mx FROM c2 GROUP BY doc_id) SELECT count(*) AS icons, 1::DOUBLE AS parse_rate, 1::DOUBLE AS roundtrip_rate, 1::DOUBLE AS fsa_valid_rate, 1::DOUBLE AS within_bound_rate, round(avg(me), 4) AS coord_err_mean, round(max(mx), 4) AS coord_err_max, round(quantile_cont(mx, 0.99), 4) AS coord_err_p99 FROM m")
def e13(spark, d):
    return evaluation.gates(fx.drawings(spark, d))


@query("e14_render_figures", "WITH m AS (SELECT row_number() OVER (ORDER BY event_id) AS k, list_transform(range(64), lambda i: (i * 7 + event_id) % 64 < event_id % 40) AS m FROM events), i AS (SELECT k, m, list_sum(list_transform(m, lambda v: v::INT)) / 64.0::DOUBLE AS ink FROM m), q AS (SELECT avg(list_sum(list_transform(range(1, 65), lambda j: (a.m[j] <> b.m[j])::INT)) / 64.0::DOUBLE) AS diversity FROM m a JOIN m b ON b.k > a.k AND b.k <= a.k + 5) SELECT count(*) AS n, round(avg(ink), 6) AS mean_ink, round(avg((ink BETWEEN 0.005 AND 0.6)::INT), 6) AS non_degenerate, (SELECT round(diversity, 6) FROM q) AS diversity FROM i")
def e14(spark, d):
    """Keys are ten apart: next is by place."""
    masks = fx.table(spark, d, "events").select((F.col("event_id") * 10).alias("event_id"), F.expr("transform(sequence(0, 63), i -> (i * 7 + event_id) % 64 < event_id % 40)").alias("mask"))
    return evaluation.render_figures(masks, "event_id")


@query("e15_generation_eval", f"WITH {LINES}, {TOKENS}, s AS (SELECT doc_id, count(*) AS c, count(DISTINCT {d_id('x', 'y')}) AS u FROM l GROUP BY doc_id), j AS (SELECT * FROM s JOIN lean USING (doc_id)) SELECT count(*) AS n_samples, 1::DOUBLE AS valid_svg_rate, 1::DOUBLE AS structural_score, round((count(DISTINCT t) / count(*)::DOUBLE + avg((2 + u + CASE WHEN c = 1 THEN 1 ELSE 2 END) / (2 * c + 2)::DOUBLE)) / 2, 6) AS diversity_score, round(avg((1 + u / c::DOUBLE + 1) / 3), 6) AS geometric_score, round(avg(2 * c + 2), 6) AS avg_token_length, min(2 * c + 2)::INT AS min_token_length, max(2 * c + 2)::INT AS max_token_length FROM j")
def e15(spark, d):
    return evaluation.generation(fx.streams(spark, d).withColumn("is_valid", F.expr(f"({grammar.validated('token_ids')}).valid")))


@query("e16_categories", f"WITH {PART} SELECT CASE kind WHEN 0 THEN 'circle' WHEN 2 THEN 'ellipse' ELSE 'rect' END AS category, count(*) AS n FROM p GROUP BY 1")
def e16(spark, d):
    rows = drawn(spark, d).withColumn("token_ids", F.expr(tokens.bracketed(f"transform(elements, e -> {shapes.composite('e')})")))
    return evaluation.categories(rows)


#: Images repeat with the number modulo 34. Sums over a window of 7 by 7 that ends at the edge repeat the edge.
_SSIM = (
    "WITH n AS (SELECT range AS e FROM range(34)), z AS (SELECT e, i // 16 AS y, i % 16 AS x, (i * 3 + e) % 17 / 16.0::DOUBLE AS a, (i * 3 + e + e % 2) % 17 / 16.0::DOUBLE AS b FROM n, range(256) r(i)), "
    "w AS (SELECT c.e, c.y, c.x, avg(v.a) AS ma, avg(v.b) AS mb, avg(v.a * v.a) AS aa, avg(v.b * v.b) AS bb, avg(v.a * v.b) AS ab FROM z c, range(-3, 4) p(dy), range(-3, 4) q(dx), z v "
    "WHERE v.e = c.e AND v.y = least(15, greatest(0, c.y + dy)) AND v.x = least(15, greatest(0, c.x + dx)) GROUP BY ALL), "
    "s AS (SELECT e, avg((2 * ma * mb + 1e-4) * (2 * (ab - ma * mb) + 9e-4) / greatest((ma * ma + mb * mb + 1e-4) * (aa - ma * ma + bb - mb * mb + 9e-4), 1e-12)) AS s FROM w GROUP BY e)"
)


@query("e5_ssim", f"{_SSIM} SELECT event_id, round(least(1, greatest(-1, s)), 6) AS ssim FROM events JOIN s ON e = event_id % 34")
def e5(spark, d):
    rows = fx.spread(fx.table(spark, d, "events")).select("event_id", F.expr("transform(sequence(0, 255), i -> pmod(i * 3 + event_id, 17) / 16D)").alias("a"), F.expr("transform(sequence(0, 255), i -> pmod(i * 3 + event_id + event_id % 2, 17) / 16D)").alias("b"))
    return evaluation.with_ssim(rows, "a", "b", 16).select("event_id", F.round("ssim", 6).alias("ssim"))


@query("f1_payload_guard", "SELECT page_id, strlen(html) * (1 + page_id % 300) AS n_bytes, CASE WHEN strlen(html) * (1 + page_id % 300) > 262144 THEN 'PAYLOAD_TOO_LARGE' END AS code, CASE WHEN strlen(html) * (1 + page_id % 300) > 262144 THEN 'svg exceeds 262144 bytes' END AS message FROM pages")
def f1(spark, d):
    """Texts of the pages' sizes, without anything else to refuse."""
    rows = fx.table(spark, d, "pages").withColumn("svg", F.expr("repeat('x', cast(octet_length(html) * (1 + page_id % 300) AS INT))")).withColumn("e", F.expr(source.guard("svg")))
    return rows.select("page_id", F.octet_length("svg").cast("long").alias("n_bytes"), "e.code", "e.message")


_NOTES = r"<!--.*?-->|<desc\b[^>]*>.*?</desc>|<title\b[^>]*>.*?</title>|<metadata\b[^>]*>.*?</metadata>"


@query("f2_strip_nonrender", f"SELECT page_id, md5(regexp_replace(html, '{_NOTES}', '', 'gis')) AS stripped FROM pages")
def f2(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.md5(F.expr(source.without_notes("html"))).alias("stripped"))


@query("f3_unsupported", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'text element' WHEN 1 THEN 'filter effects' WHEN 2 THEN 'raster image embed' WHEN 3 THEN 'symbol/use reference' WHEN 4 THEN 'SMIL animation' END AS reason FROM pages")
def f3(spark, d):
    svg = "concat('<svg>', element_at(array('<Text>', '<use/><filter/>', '<image/>', '<user/>', '<set x=\"1\"/>', '<!-- <text> --><desc><use/></desc>'), cast(page_id % 6 + 1 AS INT)), '</svg>')"
    return fx.table(spark, d, "pages").withColumn("svg", F.expr(svg)).select("page_id", F.expr(source.unsupported("svg")).alias("reason"))


@query("f8_clamp_count", f"WITH {LINES} SELECT doc_id, sum((x < 0 OR x > 300 OR y < 0 OR y > 300)::INT)::INT AS n_clamped FROM l GROUP BY doc_id")
def f8(spark, d):
    return fx.polylines(spark, d).select("doc_id", F.expr(codec.clamped_count()).alias("n_clamped"))


@query("f10_range_check", f"WITH {LINES} SELECT DISTINCT doc_id, CASE WHEN doc_id % 3 = 0 THEN 5561 + doc_id % 7 END::INT AS bad FROM l")
def f10(spark, d):
    rows = fx.streams(spark, d).withColumn("token_ids", F.expr("IF(doc_id % 3 = 0, concat(token_ids, array(cast(5561 + doc_id % 7 AS INT), -1)), token_ids)"))
    return rows.select("doc_id", F.expr(tokens.bad_id("token_ids")).alias("bad"))


@query("f11_version_guard", f"WITH {LINES} SELECT DISTINCT doc_id, CASE doc_id % 4 WHEN 0 THEN 'VERSION_REQUIRED' WHEN 1 THEN 'VOCAB_MISMATCH' WHEN 2 THEN 'VOCAB_MISMATCH' END AS code FROM l")
def f11(spark, d):
    rows = fx.streams(spark, d).withColumn("tokenizer_version", F.expr(f"CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE '{ids.TOKENIZER_VERSION}' END")).withColumn("vocab_id", F.expr("IF(doc_id % 4 = 2, 'other', NULL)"))
    return rows.select("doc_id", F.expr(f"({codec.pinned()}).code").alias("code"))


def batch_items(spark, d):
    """An item for each conversation turn: a drawing, a broken one, or neither."""
    c = fx.table(spark, d, "conversations")
    svg = "CASE WHEN (conv_id + turn) % 17 = 0 THEN '<svg><rect' WHEN (conv_id + turn) % 17 = 1 THEN NULL WHEN (conv_id + turn) % 17 = 2 THEN '<svg><use/></svg>' ELSE concat('<svg><path d=\"M', conv_id % 300, ' ', turn * 5, 'L100 100\"/></svg>') END"
    return c.select(F.expr("concat(conv_id, '-', turn)").alias("id"), F.lit("tokenize").alias("op"), F.expr(svg).alias("svg"), F.lit(None).cast("array<int>").alias("token_ids"), F.lit("L1").alias("level"), F.lit(True).alias("lean"))


_ITEMS = f"SELECT conv_id || '-' || turn AS id, (conv_id + turn) % 17 AS m, '1,10,' || {d_id('(conv_id % 300)::DOUBLE', '(turn * 5)::DOUBLE')} || ',11,' || {d_id('100::DOUBLE', '100::DOUBLE')} || ',2' AS t FROM conversations"
_RESULT = f"SELECT id, m > 2 AS ok, CASE m WHEN 0 THEN 'PARSE_ERROR' WHEN 1 THEN 'PARSE_ERROR' WHEN 2 THEN 'PARSE_UNSUPPORTED_ELEMENT' END AS code, CASE WHEN m > 2 THEN t END AS t FROM ({_ITEMS})"


@query("v3_batch", _RESULT)
def v3(spark, d):
    return service.process(batch_items(spark, d)).select("id", "ok", F.col("error.code").alias("code"), F.expr(TEXT).alias("t"))


@query("v3_batch_counts", f"SELECT count_if(ok)::BIGINT AS n_ok, count_if(NOT ok)::BIGINT AS n_failed FROM ({_RESULT})")
def v3c(spark, d):
    return service.counts(service.process(batch_items(spark, d)))


@query("s4_ndjson_items", f"SELECT id, m % 5 = 0 AS bad FROM ({_ITEMS}) WHERE m % 5 <> 0 UNION ALL SELECT NULL, true FROM ({_ITEMS}) WHERE m % 5 = 0")
def s4(spark, d):
    line = "IF(cast(split(id, '-')[0] AS INT) + cast(split(id, '-')[1] AS INT) IS NOT NULL AND (cast(split(id, '-')[0] AS INT) + cast(split(id, '-')[1] AS INT)) % 17 % 5 = 0, '{bad', to_json(named_struct('id', id, 'op', op, 'svg', svg)))"
    return service.items(batch_items(spark, d).select(F.expr(line).alias("value"))).select("id", "bad")


@query("m3_collate", f"WITH {LONG}, n AS (SELECT doc_id, least(max(pos) + 1, 12) AS n FROM t GROUP BY doc_id), w AS (SELECT doc_id, n, max(n) OVER (PARTITION BY doc_id // 8) AS w FROM n) SELECT doc_id, (w - 1)::INT AS width, (n - 1)::INT AS real, sum(tok) FILTER (WHERE pos < n - 1)::BIGINT AS input_sum, sum(tok) FILTER (WHERE pos BETWEEN 1 AND n - 1)::BIGINT AS target_sum FROM t JOIN w USING (doc_id) GROUP BY doc_id, w, n")
def m3(spark, d):
    rows = mldata.collate(fx.streams(spark, d).withColumn("batch", F.floor(F.col("doc_id") / 8)), "batch", 12)
    total = lambda c: F.expr(f"aggregate({c}, 0L, (a, v) -> a + v)")
    return rows.select("doc_id", F.size("input_ids").alias("width"), total("attention_mask").cast("int").alias("real"), total("input_ids").alias("input_sum"), total("target_ids").alias("target_sum"))


@query("m4_type_ids", f"WITH {LONG} SELECT doc_id, pos::INT AS pos, (CASE WHEN tok < 10 THEN 0 WHEN tok < 20 THEN 1 ELSE 6 END)::INT AS type_id FROM t")
def m4(spark, d):
    return placed(spark, d).select("doc_id", "pos", F.expr(ids.embedding_class("token_id")).alias("type_id"))


@query("m4_vocabulary_types", f"WITH {LONG}, y AS (SELECT t::INT AS token_id, (CASE WHEN t < 10 THEN 0 WHEN t < 20 THEN 1 WHEN t < 30 THEN 2 WHEN t BETWEEN 30 AND 33 THEN 3 WHEN t BETWEEN 40 AND 55 THEN 4 WHEN t BETWEEN 60 AND 79 THEN 5 ELSE 6 END)::INT AS type_id FROM range(5561) r(t)) SELECT token_id, type_id, count(t.tok) AS n FROM y LEFT JOIN t ON t.tok = y.token_id GROUP BY ALL")
def m4_types(spark, d):
    """The type of every id, and how often the orders' streams hold it."""
    rows = manifest.vocabulary(spark).select("token_id", F.expr(ids.embedding_class("token_id")).alias("type_id"))
    return rows.join(used(spark, d), "token_id", "left").select("token_id", "type_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("m5_coord_lut", f"WITH {VOCAB_SQL}, {LONG} SELECT doc_id, pos::INT AS pos, round(coalesce(l / 6.0::DOUBLE, 0), 9) AS level, round(coalesce((o % g + 0.5) / g::DOUBLE, 0), 9) AS x, round(coalesce((o // g + 0.5) / g::DOUBLE, 0), 9) AS y FROM t JOIN u ON u.t = t.tok")
def m5(spark, d):
    """Level and centre of every token of the orders' streams, from the table of ids."""
    table = manifest.vocabulary(spark).withColumn("c", F.expr(mldata.lookup("token_id")))
    rows = placed(spark, d).join(F.broadcast(table), "token_id")  # a row for each id of the vocabulary
    return rows.select("doc_id", "pos", *[F.round(F.expr(f"c[{i}]"), 9).alias(n) for i, n in enumerate(("level", "x", "y"))])


@query("m6_positions", f"WITH {LONG} SELECT doc_id, pos::INT AS pos, i::INT AS i, round(CASE WHEN i % 2 = 0 THEN sin(pos * exp(-(i // 2) * 2 * ln(10000) / 8)) ELSE cos(pos * exp(-(i // 2) * 2 * ln(10000) / 8)) END, 6) AS v FROM t, range(8) b(i)")
def m6(spark, d):
    """The waves of every place in the orders' streams."""
    return placed(spark, d).select("doc_id", "pos", F.posexplode(F.expr(mldata.positions("pos", 8))).alias("i", "v")).select("doc_id", "pos", "i", F.round("v", 6).alias("v"))


@query("m7_spatial_encoding", "WITH p AS (SELECT event_id, value / 500 AS x, (event_id % 100) / 100.0::DOUBLE AS y FROM events), r AS (SELECT event_id, i, CASE WHEN i % 2 = 0 THEN sin(x * 2 * pi() * pow(2, (i // 2) * 6.0 / 4)) ELSE cos(y * 2 * pi() * pow(2, (i // 2) * 6.0 / 4)) END AS v FROM p, range(8) b(i)) SELECT event_id, i::INT AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY event_id)), 5) + 0.0 AS v FROM r")
def m7(spark, d):
    rows = fx.table(spark, d, "events").select("event_id", F.posexplode(F.expr(mldata.spatial("(value / 500)", "((event_id % 100) / 100D)", 8))).alias("i", "v"))
    return rows.select("event_id", "i", F.round("v", 5).alias("v"))


@query("m8_cosine", "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m8(spark, d):
    e = fx.table(spark, d, "embeddings")
    rows = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return rows.select("vec_id", F.round(F.expr(mldata.cosine("a", "b")), 6).alias("cosine"))


@query("m13_nucleus", "WITH p AS (SELECT user_id, event_id, value / sum(value) OVER (PARTITION BY user_id) AS p FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_id) AS r FROM p), m AS (SELECT *, p / sum(p) OVER (PARTITION BY user_id) AS q FROM k WHERE r <= 5), c AS (SELECT *, sum(q) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM m) SELECT user_id, event_id FROM c WHERE coalesce(c, 0) < 0.8")
def m13(spark, d):
    e = fx.table(spark, d, "events")
    from pyspark.sql import Window

    rows = e.select("user_id", "event_id", (F.col("value") / F.sum("value").over(Window.partitionBy("user_id"))).alias("p"))
    return mldata.nucleus(rows, "user_id", "event_id", "p", 5, 0.8).select("user_id", "event_id")


def _table(*pairs) -> str:
    """SQL: a JSON object of numbers and names, by the text of the numbers."""
    return "(SELECT '{' || string_agg('\"' || k || '\":\"' || v || '\"', ',' ORDER BY k) || '}' FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in pairs) + ") z(k, v))"


#: The canonical JSON of the manifest: keys in order, no blanks.
_MANIFEST = (
    "'{\"canvas_size\":300.0,\"command\":' || " + _table((10, "MOVE"), (11, "LINE"), (12, "HLINE"), (13, "VLINE"), (14, "CUBIC"), (15, "QUADRATIC"), (16, "ARC"), (17, "CLOSE"))
    + " || ',\"composite\":' || " + _table((20, "CIRCLE"), (21, "ELLIPSE"), (22, "RECT"), (23, "ROUND_RECT")) + " || ',\"continuity\":' || " + _table((30, "DISC"), (31, "G0"), (32, "G1"), (33, "G2"))
    + " || ',\"coord_token_base\":100,\"curvature\":' || (SELECT '{' || string_agg('\"' || (40 + i) || '\":\"CURV@' || i || '\"', ',' ORDER BY i) || '}' FROM range(16) r(i))"
    " || ',\"level_layout\":' || (SELECT '[' || string_agg('{\"grid\":' || pow(2, l)::INT || ',\"level\":' || l || ',\"n_tokens\":' || pow(4, l)::INT || ',\"start_id\":' || (100 + (pow(4, l)::INT - 1) // 3) || '}', ',' ORDER BY l) || ']' FROM range(7) r(l))"
    " || ',\"max_coord_level\":6,\"merge_base_id\":null,\"merges\":null,\"spatial\":' || "
    + _table((60, "ALIGN_CENTER_H"), (61, "ALIGN_CENTER_V"), (62, "SYM_REFLECT_X"), (63, "SYM_REFLECT_Y"), (64, "EQUAL_SPACE_H"), (65, "EQUAL_SPACE_V"), (66, "EQUAL_SIZE"), (67, "REPEAT_2"), (68, "REPEAT_3"), (69, "REPEAT_4"), (70, "REPEAT_N"))
    + " || ',\"special\":' || " + _table((0, "PAD"), (1, "BOS"), (2, "EOS"), (3, "SEP"), (4, "UNK")) + " || ',\"tokenizer_version\":\"strokeforge-1.0.0\",\"vocab_id\":\"geom-5561-v1\",\"vocab_size\":5561}'"
)


@query("s16_manifest_hash", f"SELECT substr(sha256({_MANIFEST}), 1, 16) AS hash, 5561 AS vocab_size")
def s16(spark, d):
    m = manifest.from_json(manifest.to_json(manifest.build()))
    return spark.createDataFrame([(manifest.content_hash(m), m["vocab_size"])], "hash string, vocab_size int")


@query("c13_predicates", f"WITH {CUBICS}, v AS (SELECT vec_id, i, x1-x0 AS ax, y1-y0 AS ay, x3-x2 AS bx, y3-y2 AS bz FROM s) SELECT vec_id, i::INT AS i, CASE WHEN sqrt(ax*ax+ay*ay) < 1e-12 OR sqrt(bx*bx+bz*bz) < 1e-12 THEN true ELSE acos(greatest(-1, least(1, (ax*bx+ay*bz) / (sqrt(ax*ax+ay*ay) * sqrt(bx*bx+bz*bz))))) < 0.1 END AS g1, abs(ax - bx) < 0.05 AS g2 FROM v")
def c13(spark, d):
    rows = fx.cubics(spark, d).select("vec_id", F.posexplode(F.expr("filter(cmds, k -> k.c = 'C')")).alias("i", "k"))
    rows = rows.selectExpr("vec_id", "i", "k.p[0] - k.sx AS ax", "k.p[1] - k.sy AS ay", "k.ex - k.p[2] AS bx", "k.ey - k.p[3] AS by")
    return rows.select("vec_id", "i", F.expr(curves.same_direction("ax", "ay", "bx", "by")).alias("g1"), F.expr(curves.same_curvature("ax", "bx")).alias("g2"))


_DEEP = lambda v: f"least(floor({v} / (300::DOUBLE / pow(2, level)))::INT, pow(2, level)::INT - 1)"


@query("t5_adaptive_tokens", f"WITH {_LEAF} SELECT vec_id, string_agg('11,' || (100 + (pow(4, level)::INT - 1) // 3 + {_DEEP('py')} * pow(2, level)::INT + {_DEEP('px')}), ',' ORDER BY i) AS t FROM leaf JOIN o USING (vec_id, i) GROUP BY vec_id")
def t5(spark, d):
    rows = segment_rows(spark, d).withColumn("c", F.col("kmax") * F.col("len"))
    s = quadtree.nodes(rows, "vec_id")
    lines = fx.cubics(spark, d).join(s, "vec_id", "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<int>")))
    start = "transform(filter(cmds, k -> k.c = 'C'), k -> named_struct('c', 'L', 'p', array(k.sx, k.sy), 'sx', k.sx, 'sy', k.sy, 'ex', k.sx, 'ey', k.sy))"
    rows = lines.withColumn("starts", F.expr(start)).withColumn("token_ids", F.expr(tokens.adaptive("starts", "nodes")))
    return rows.select("vec_id", F.expr(TEXT).alias("t"))


@query("t13_baseline_count", "SELECT n_nationkey::BIGINT AS doc_id, (2 + 3 * (n_nationkey % 5 + 2) + (n_nationkey % 5 + 1))::INT AS n_tokens FROM nation")
def t13(spark, d):
    rows = codec.parsed(fx.layouts(spark, d)).withColumn("bodies", F.expr(f"transform(elements, e -> {shapes.composite('e')})"))
    return rows.select("doc_id", F.expr(tokens.baseline_count("bodies")).alias("n_tokens"))


@query("f16_drawable", "SELECT p_partkey, p_partkey % 5 IN (0, 1) AS drawable FROM part")
def f16(spark, d):
    text = "element_at(array('M1 1L2 2', ' m1,1 h5z', 'M1 1 Z', 'L2 2', 'M1 1 L2'), cast(p_partkey % 5 + 1 AS INT))"
    return fx.table(spark, d, "part").withColumn("path_text", F.expr(text)).select("p_partkey", F.expr(path.is_drawable("path_text")).alias("drawable"))


@query("q15_cell_number", f"WITH {LONG} SELECT doc_id, pos::INT AS pos, (CASE WHEN tok >= 100 THEN tok - 100 END)::INT AS number FROM t")
def q15(spark, d):
    return placed(spark, d).select("doc_id", "pos", F.expr(ids.cell_number("token_id")).alias("number"))


@query("s11_vocab_lookup", "SELECT v.vocab_id, CASE WHEN v.vocab_id <> 'geom-5561-v1' THEN 'INVALID_REQUEST' END AS code FROM (VALUES ('geom-5561-v1'), ('other')) v(vocab_id)")
def s11(spark, d):
    wanted = spark.createDataFrame([("geom-5561-v1",), ("other",)], "vocab_id string")
    return manifest.lookup(manifest.stored(spark, [manifest.build()]), wanted).select("vocab_id", F.col("error.code").alias("code"))


@query("flagship_roundtrip", f"WITH {LINES} SELECT doc_id, (2 * count(*) + 2)::INT AS n_tokens, true AS valid, round(max({_LERR}), 6) AS max_error, {_D} AS d FROM l GROUP BY doc_id")
def flagship(spark, d):
    """Encode every order's line, check the grammar, decode, measure."""
    rows = line_errors(spark, d)
    return rows.select("doc_id", F.size("token_ids").alias("n_tokens"), F.expr(f"({grammar.validated('token_ids')}).valid").alias("valid"), F.round(F.array_max("errs"), 6).alias("max_error"), F.expr(decode.path_text("token_ids")).alias("d"))
