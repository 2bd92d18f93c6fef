"""Queries over drawings of which each has its own canvas, level, vocabulary and merges: those of its customer's nation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import ids
from ..operators import configured, manifest, service
from ..sources import svg as source
from . import fixtures as fx
from .core import LINES, PART, d_trim
from .registry import query

# SQL for both engines: the canvas and level of a nation's vocabulary, and the cell that one merge joins with LINE.
CANVAS, LEVEL = "(100.0 + 50 * (n_nationkey % 5))", "(3 + n_nationkey % 4)"
SIZES = [(ids.level_base(k), ids.level_base(k + 1)) for k in (3, 4, 5, 6)]
_PICK = lambda values: f"CASE n_nationkey % 4 WHEN 0 THEN {values[0]} WHEN 1 THEN {values[1]} WHEN 2 THEN {values[2]} ELSE {values[3]} END"
FIRST, BASE = _PICK([a for a, _ in SIZES]), _PICK([b for _, b in SIZES])
_MERGES = f"CASE WHEN n_nationkey % 3 = 0 THEN concat('[[11,', {BASE} - 1, ',', {BASE}, ']]') ELSE 'null' END"
#: One nation in eight has no manifest, one has a level that can't be used.
NONE, BAD = "n_nationkey % 8 = 7", "n_nationkey = 12"
TEXT = f"concat('{{\"canvas_size\":', 100 + 50 * (n_nationkey % 5), '.0,\"max_coord_level\":', CASE WHEN {BAD} THEN 9 ELSE {LEVEL} END, ',\"merges\":', {_MERGES}, ',\"vocab_id\":\"nation-', n_nationkey, '\"}}')"
VOCAB = "concat('nation-', {})"


def manifests(spark, d) -> DataFrame:
    return fx.table(spark, d, "nation").filter(f"NOT ({NONE})").select(F.expr(VOCAB.format("n_nationkey")).alias("vocab_id"), F.expr(TEXT).alias("manifest"))


def drawn(spark, d) -> DataFrame:
    """doc_id, vocab_id, pts, svg: every order's line, in the vocabulary of its customer's nation."""
    rows = fx.polylines(spark, d).select("doc_id", "pts")
    owner = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    nation = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.expr(VOCAB.format("c_nationkey")).alias("vocab_id"))
    d_ = "array_join(transform(pts, (p, i) -> concat(IF(i = 0, 'M ', 'L '), p.x, ' ', p.y)), ' ')"
    svg = f"""concat('<svg xmlns="http://www.w3.org/2000/svg"><path d="', {d_}, '"/></svg>')"""
    return rows.join(owner.join(nation, "o_custkey"), "doc_id").select("doc_id", "vocab_id", "pts", F.expr(svg).alias("svg"))


# DuckDB's side: cf, the configurations; pq, every point with its cell; dq, every document with its tokens.
_CF = f"cf AS (SELECT n_nationkey, 'nation-' || n_nationkey AS vocab_id, {CANVAS}::DOUBLE AS canvas, {LEVEL} AS lv, {FIRST} AS first, {BASE} AS base, n_nationkey % 3 = 0 AS has, {NONE} AS gone, {BAD} AS bad, {TEXT} AS m FROM nation)"
_Q = lambda v: f"least(floor(greatest(0, least({v}, canvas - 1e-6)) / (canvas / pow(2, lv))), pow(2, lv) - 1)::INT"
_PQ = (
    f"{LINES}, {_CF}, ow AS (SELECT o_orderkey AS doc_id, cf.* FROM orders JOIN customer ON c_custkey = o_custkey JOIN cf ON n_nationkey = c_nationkey), "
    f"pq AS (SELECT l.doc_id, n, x, y, ow.* EXCLUDE doc_id, {_Q('x')} AS qx, {_Q('y')} AS qy FROM l JOIN ow USING (doc_id)), "
    "pt AS (SELECT *, (first + qy * pow(2, lv)::INT + qx)::INT AS c FROM pq)"
)
_MERGED = "has AND n > 1 AND c = base - 1"
_CODE = "CASE WHEN any_value(gone) OR any_value(bad) THEN 'INVALID_REQUEST' END"
_FINE = "NOT any_value(gone) AND NOT any_value(bad)"


@query(
    "t20_configured",
    f"WITH {_PQ} SELECT doc_id, any_value(vocab_id) AS vocab_id, CASE WHEN {_FINE} THEN '1,' || string_agg(CASE WHEN {_MERGED} THEN base::VARCHAR WHEN n = 1 THEN '10,' || c ELSE '11,' || c END, ',' ORDER BY n) || ',2' END AS t, "
    f"CASE WHEN {_FINE} THEN (2 + count(*) + count_if(NOT ({_MERGED})))::INT END AS n_tokens, CASE WHEN {_FINE} THEN count_if(x > canvas OR y > canvas)::INT END AS n_clamped, "
    f"CASE WHEN any_value(has) AND {_FINE} THEN 'L2' ELSE 'L1' END AS level, CASE WHEN {_FINE} THEN substr(sha256(any_value(m)), 1, 16) END AS content_hash, {_CODE} AS code FROM pt GROUP BY doc_id",
)
def t20(spark, d):
    """Every order's drawing on level L2 of the vocabulary that it names."""
    out = configured.tokenize(drawn(spark, d), configured.load(manifests(spark, d)), "L2", lean=True)
    return out.select("doc_id", "vocab_id", F.expr("array_join(token_ids, ',')").alias("t"), F.expr("IF(error IS NULL, n_tokens, NULL)").alias("n_tokens"), "n_clamped", "level", "content_hash", F.col("error.code").alias("code"))


_XY = " || ' ' || ".join(d_trim(f"(({q} + 0.5::DOUBLE) * (canvas / pow(2, lv)))") for q in ("qx", "qy"))
_HEAD = "'<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"' || canvas::INT || '\" height=\"' || canvas::INT || '\" viewBox=\"0 0 ' || canvas::INT || ' ' || canvas::INT || '\">'"


@query(
    "t20_decoded",
    f"WITH {_PQ}, dd AS (SELECT doc_id, any_value(vocab_id) AS vocab_id, any_value({_HEAD}) || chr(10) || '  <path d=\"' || string_agg(CASE WHEN n = 1 THEN 'M ' ELSE 'L ' END || {_XY}, ' ' ORDER BY n) || '\" fill=\"none\" stroke=\"black\" stroke-width=\"1\"/>' || chr(10) || '</svg>' AS svg, "
    f"{_FINE} AS fine, any_value(canvas) AS canvas, any_value(round(canvas / pow(2, lv) / 2 * sqrt(2), 4)) AS coord_max_px FROM pt GROUP BY doc_id) "
    "SELECT doc_id, vocab_id, CASE WHEN fine THEN svg END AS svg, CASE WHEN fine THEN true END AS valid, CASE WHEN fine THEN canvas END AS canvas, CASE WHEN fine THEN coord_max_px END AS coord_max_px, CASE WHEN NOT fine THEN 'INVALID_REQUEST' END AS code FROM dd",
)
def t20_decoded(spark, d):
    """There and back: each stream is decoded by the manifest that it was encoded by."""
    c = configured.load(manifests(spark, d))
    there = configured.tokenize(drawn(spark, d), c, "L2", lean=True).select("doc_id", "vocab_id", "tokenizer_version", "token_ids")
    back = configured.detokenize(there, c)
    fine = lambda v: F.when(F.col("error").isNull(), F.col(v))
    return back.select("doc_id", "vocab_id", fine("svg").alias("svg"), fine("valid").alias("valid"), F.col("fidelity.canvas").alias("canvas"), fine("fidelity.coord_max_px").alias("coord_max_px"), F.col("error.code").alias("code"))


@query(
    "t20_pins",
    f"WITH {_PQ}, up AS (SELECT doc_id, any_value(vocab_id) AS v, any_value(base) + any_value(has)::INT AS u, any_value(gone) AS gone, any_value(bad) AS bad FROM pt GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'VERSION_REQUIRED' WHEN gone OR bad THEN 'INVALID_REQUEST' WHEN doc_id % 3 = 1 AND u <= 1505 THEN 'VOCAB_MISMATCH' END AS code, "
    "CASE WHEN doc_id % 3 = 0 THEN 'tokenizer_version is required for detokenize' WHEN gone THEN 'unknown vocab_id ' || v WHEN bad THEN 'manifest of ' || v || ' has no level of 1 to 6' WHEN doc_id % 3 = 1 AND u <= 1505 THEN 'token id 1505 out of range [0,' || u || ')' END AS message FROM up",
)
def t20_pins(spark, d):
    """What refuses a stream depends on its own vocabulary: 1505 is an id of some and out of others' range."""
    rows = drawn(spark, d).select("doc_id", "vocab_id", F.expr(f"IF(doc_id % 3 = 0, NULL, '{ids.TOKENIZER_VERSION}')").alias("tokenizer_version"), F.expr("IF(doc_id % 3 = 1, array(1, 10, 1505, 2), array(1, 10, 110, 2))").alias("token_ids"))
    back = configured.detokenize(rows, configured.load(manifests(spark, d)), measure=False)
    return back.select("doc_id", F.col("error.code").alias("code"), F.col("error.message").alias("message"))


@query(
    "t20_batch",
    f"WITH {_PQ}, oo AS (SELECT doc_id, any_value(vocab_id) AS vocab_id, any_value(gone OR bad) AS refused, any_value(has) AS has, 2 + count(*) + count_if(NOT ({_MERGED})) AS n FROM pt GROUP BY doc_id) "
    "SELECT vocab_id, CASE WHEN refused THEN NULL WHEN has THEN 'L2' ELSE 'L1' END AS level, CASE WHEN refused THEN 400 END AS status, count(*) AS n_items, CASE WHEN refused THEN NULL ELSE sum(n)::BIGINT END AS n_tokens FROM oo GROUP BY vocab_id, refused, has",
)
def t20_batch(spark, d):
    """Items of one batch in many vocabularies."""
    items = drawn(spark, d).select(F.col("doc_id").alias("pos"), F.col("vocab_id").alias("id"), "vocab_id", "svg", F.lit(None).cast("array<int>").alias("token_ids"))
    out = service.process(items, lean=True, level="L2", configs=configured.load(manifests(spark, d)))
    return out.groupBy(F.col("id").alias("vocab_id"), "level", F.col("error.status").alias("status")).agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))


# Bounds, layouts, hashes and look-ups of the vocabularies in use.
_USED = f"{_CF}, us AS (SELECT n_nationkey, count(*) AS n_customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey)"


def used(spark, d) -> DataFrame:
    return fx.table(spark, d, "customer").groupBy(F.expr(VOCAB.format("c_nationkey")).alias("vocab_id")).agg(F.count("*").alias("n_customers"))


@query("q7_bounds_in_use", f"WITH {_PQ}, er AS (SELECT doc_id, n, vocab_id, canvas, lv, sqrt(pow((qx + 0.5::DOUBLE) * (canvas / pow(2, lv)) - least(x, canvas), 2) + pow((qy + 0.5::DOUBLE) * (canvas / pow(2, lv)) - least(y, canvas), 2)) AS err FROM pt WHERE NOT gone AND NOT bad) SELECT vocab_id, round(any_value(canvas / pow(2, lv) / 2 * sqrt(2)), 6) AS bound, round(max(err), 6) AS worst, true AS kept, count(*) AS n_points FROM er GROUP BY vocab_id")
def q7_used(spark, d):
    """The bound of each vocabulary in use beside the worst error of a point inside its canvas."""
    c = configured.load(manifests(spark, d))
    rows = configured.joined(drawn(spark, d), c).filter("_bad IS NULL").select("vocab_id", "_canvas", "_level", F.explode("pts").alias("p"))
    rows = rows.select("vocab_id", "_canvas", "_level", F.expr("least(p.x, _canvas)").alias("x"), F.expr("least(p.y, _canvas)").alias("y")).withColumn("t", F.expr(ids.coord_id("x", "y", "_level", "_canvas")))
    err = f"sqrt(power({ids.x_of('t', '_canvas')} - x, 2) + power({ids.y_of('t', '_canvas')} - y, 2))"
    out = rows.groupBy("vocab_id").agg(F.first(F.expr(ids.bound("_level", "_canvas"))).alias("b"), F.max(F.expr(err)).alias("e"), F.count("*").alias("n_points"))
    return out.select("vocab_id", F.round("b", 6).alias("bound"), F.round("e", 6).alias("worst"), F.expr("e <= b + 1e-6").alias("kept"), "n_points")


@query("q10_scalars_in_use", f"WITH {_CF}, sc AS (SELECT c_custkey, canvas, pow(4, lv) - 1 AS top, first, pow(2, lv)::INT AS g, round_even(greatest(0, least(c_acctbal::DOUBLE / 20, canvas)) / canvas * (pow(4, lv) - 1), 0)::INT AS k FROM customer JOIN cf ON n_nationkey = c_nationkey WHERE NOT gone AND NOT bad) SELECT c_custkey, (first + k % g * g + k // g)::INT AS token_id, round(k / top * canvas, 6) AS back, round(canvas / top / 2, 9) AS bound FROM sc")
def q10_used(spark, d):
    """Customers' balances as scalars of their vocabularies, and the bound of a scalar."""
    rows = fx.table(spark, d, "customer").select("c_custkey", F.expr("cast(c_acctbal AS DOUBLE) / 20").alias("v"), F.expr(VOCAB.format("c_nationkey")).alias("vocab_id"))
    rows = configured.joined(rows, configured.load(manifests(spark, d))).filter("_bad IS NULL").withColumn("token_id", F.expr(ids.scalar_id("v", "_canvas", "_level")))
    return rows.select("c_custkey", "token_id", F.round(F.expr(ids.scalar_of("token_id", "_canvas", "_level")), 6).alias("back"), F.round(F.expr(f"_canvas / ({ids.codes('_level')} - 1) / 2"), 9).alias("bound"))


@query("s11_vocabularies_in_use", f"WITH {_USED} SELECT vocab_id, n_customers, CASE WHEN gone THEN 'INVALID_REQUEST' END AS code, CASE WHEN NOT gone THEN substr(sha256(m), 1, 16) END AS content_hash FROM us JOIN cf USING (n_nationkey)")
def s11_used(spark, d):
    """The manifest of every vocabulary that customers use, with its hash."""
    stored = manifests(spark, d).withColumn("content_hash", F.substring(F.sha2("manifest", 256), 1, 16))
    rows = used(spark, d)
    return rows.join(manifest.lookup(stored, rows), "vocab_id").select("vocab_id", "n_customers", F.col("error.code").alias("code"), "content_hash")


@query("q18_layouts_in_use", f"WITH {_USED} SELECT vocab_id, l::INT AS level, (100 + (pow(4, l)::INT - 1) // 3)::INT AS start_id, (pow(2, l))::INT AS grid, round(canvas / pow(2, l), 6) AS cell, n_customers FROM us JOIN cf USING (n_nationkey), range(7) r(l) WHERE NOT gone AND NOT bad AND l <= lv")
def q18_used(spark, d):
    """The levels of every vocabulary that customers use."""
    rows = configured.joined(used(spark, d), configured.load(manifests(spark, d))).filter("_bad IS NULL").withColumn("level", F.explode(F.expr("sequence(0, _level)")))
    return rows.select("vocab_id", "level", F.expr(ids.first_id("level")).alias("start_id"), F.expr(ids.side("level")).alias("grid"), F.round(F.expr(ids.cell_size("level", "_canvas")), 6).alias("cell"), "n_customers")


# Errors and guards over the tables.
_F14 = {0: "NULL", 1: "'PARSE_UNSUPPORTED_ELEMENT'", 2: "'PARSE_ERROR'", 3: "'PAYLOAD_TOO_LARGE'", 4: "'VOCAB_MISMATCH'", 5: "'INVALID_REQUEST'"}


@query(
    "f14_errors_of_items",
    f"WITH {PART}, c AS (SELECT CASE k % 6 {' '.join(f'WHEN {k} THEN {v}' for k, v in _F14.items())} END AS code FROM p) "
    "SELECT code, CASE WHEN code = 'PAYLOAD_TOO_LARGE' THEN 413 WHEN code IS NOT NULL THEN 400 END AS status, CASE code WHEN 'PAYLOAD_TOO_LARGE' THEN '262144' WHEN 'PARSE_UNSUPPORTED_ELEMENT' THEN 'text element' WHEN 'VOCAB_MISMATCH' THEN '5561' END AS detail, count(*) AS n FROM c GROUP BY ALL",
)
def f14_items(spark, d):
    """Every kind of error that an item can have, with its status and detail, over the drawings of all parts."""
    svg = f"CASE doc_id % 6 WHEN 1 THEN replace(svg, '</g>', '<text>a</text></g>') WHEN 2 THEN replace(svg, '</g>', '') WHEN 3 THEN concat(svg, repeat(' ', {source.MAX_BYTES})) WHEN 4 THEN NULL ELSE svg END"
    rows = fx.drawings(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.expr(svg).alias("svg"), F.expr("IF(doc_id % 6 = 4, array(1, 10, 5561, 2), NULL)").alias("token_ids"), F.expr("IF(doc_id % 6 = 5, 'paint', NULL)").alias("op"))
    out = service.process(rows, lean=True)
    detail = F.coalesce(*[F.col("error.detail")[k] for k in ("limit", "reason", "max_id")])
    return out.groupBy(F.col("error.code").alias("code"), F.col("error.status").alias("status"), detail.alias("detail")).agg(F.count("*").alias("n"))


@query(
    "f12_batches_of_tables",
    "WITH b AS (SELECT 'tokenize' AS op, n_regionkey AS batch, count(*) AS n, sum(length(s_name) + length(n_name)) AS size FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_regionkey UNION ALL "
    "SELECT 'detokenize', n_regionkey, count(*), 0 FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey UNION ALL SELECT 'paint', n_regionkey, count(*), 0 FROM nation GROUP BY n_regionkey UNION ALL SELECT 'tokenize', 99, count(*), 0 FROM customer) "
    "SELECT op, batch::INT AS batch, CASE WHEN op = 'paint' THEN 'INVALID_REQUEST' WHEN n > 1000 OR size > 33554432 THEN 'PAYLOAD_TOO_LARGE' END AS code FROM b",
)
def f12_tables(spark, d):
    """Batches of suppliers and customers by region, and of all customers: those too large and of no known operation are refused."""
    nation = fx.table(spark, d, "nation")
    name = lambda t, p: fx.table(spark, d, t).join(nation, F.col(p + "nationkey") == F.col("n_nationkey")).select("n_regionkey", F.concat(p + "name", "n_name").alias("svg"), F.lit(None).cast("array<int>").alias("token_ids"))
    suppliers, customers = name("supplier", "s_"), name("customer", "c_")
    regions, out = sorted(r[0] for r in nation.select("n_regionkey").distinct().collect()), []  # five
    batches = [(op, r, rows.filter(F.col("n_regionkey") == r)) for op, rows in (("tokenize", suppliers), ("detokenize", customers), ("paint", suppliers)) for r in regions]
    for op, r, rows in [*batches, ("tokenize", 99, customers)]:
        try:
            service.check_batch(rows, op)
            out.append((op, r, None))
        except EngineError as e:
            out.append((op, r, e.code))
    return spark.createDataFrame(out, "op string, batch int, code string")


