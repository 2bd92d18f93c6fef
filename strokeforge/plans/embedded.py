"""Queries over embeddings of streams and the weights that they begin with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedding
from . import fixtures as fx
from .core import LINES, TOKENS
from .registry import query

D, D_TYPE, D_COORD = 4, 2, 3
_HEX = "((('0x' || substr(md5({k}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE)"


def _u(key: str) -> str:
    return _HEX.format(k=key)


def _g(key: str) -> str:
    return f"(sqrt(-2 * ln({_u(f'{key} || ' + repr(':a'))})) * cos(2 * pi() * {_u(f'{key} || ' + repr(':b'))}))"


def _weights(version: int) -> str:
    """SQL of DuckDB: f (t, l, x, y: ids with their level and the centre of their cell) and w (t, j, v: weights, in long form)."""
    freq = "pow(2, j // 2 * 4.0 - 2)" if version == 2 else "pow(2, j // 2 * 3.0)"
    at = "42 || ':' || t || ':' || j"
    noise = _g("'noise:' || " + at)
    cell = f"e + 0.01 * {noise}" if version == 2 else f"e * pow(0.8, l) + (j = least(l, {D - 1}))::INT * 0.1 + 0.01 * {noise}"
    one = f"CASE WHEN t = 0 THEN 0 WHEN k IS NOT NULL THEN c + (t BETWEEN 10 AND 17)::INT * 0.1 * {_g(repr('base:42:') + ' || j')} + coalesce(way * s * 0.5, 0) + (t IN (12, 13, 15) OR t BETWEEN 20 AND 23 OR t BETWEEN 60 AND 70)::INT * 0.02 * {noise} WHEN l IS NOT NULL THEN {cell} ELSE (2 * {_u(repr('other:') + ' || ' + at)} - 1) * sqrt(6.0::DOUBLE / {5561 + D}) END"
    last = "v / greatest(sqrt(sum(v * v) OVER (PARTITION BY t)), 1e-8)" if version == 2 else "v"
    return (
        f"ce AS (SELECT k, j, z / sqrt(sum(z * z) OVER (PARTITION BY k)) * 0.3 AS c FROM (SELECT k, j, {_g(repr('centre:') + ' || (42 + 7 * k) || ' + repr(':') + ' || j')} AS z FROM range(14) a(k), range({D}) b(j))), "
        "f AS (SELECT t, l, (o % g + 0.5) / g AS x, (o // g + 0.5) / g AS y FROM (SELECT t, l, pow(2, l)::BIGINT AS g, t - 100 - (pow(4, l)::BIGINT - 1) // 3 AS o FROM (SELECT t, CASE WHEN t >= 100 THEN floor(log2(3 * (t - 100) + 1.5) / 2)::BIGINT END AS l FROM range(5561) r(t)))), "
        "g AS (SELECT *, CASE WHEN t = 10 THEN 0 WHEN t BETWEEN 11 AND 13 THEN 1 WHEN t IN (14, 15) THEN 2 WHEN t = 16 THEN 3 WHEN t = 17 THEN 4 WHEN t IN (20, 21) THEN 5 WHEN t IN (22, 23) THEN 6 WHEN t IN (60, 61) THEN 7 WHEN t IN (62, 63) THEN 8 WHEN t BETWEEN 64 AND 70 THEN 9 WHEN t BETWEEN 30 AND 33 THEN 10 WHEN t BETWEEN 40 AND 55 THEN 12 END AS k, "
        "CASE WHEN t BETWEEN 30 AND 33 THEN 11 WHEN t BETWEEN 40 AND 55 THEN 13 END AS m, CASE WHEN t BETWEEN 30 AND 33 THEN (t - 30) / 3.0::DOUBLE WHEN t BETWEEN 40 AND 55 THEN (t - 40) / 15.0::DOUBLE END AS s FROM f), "
        f"h AS (SELECT *, z / sqrt(sum(z * z) OVER (PARTITION BY t)) AS e FROM (SELECT g.*, j, CASE WHEN j % 2 = 0 THEN sin(x * 2 * pi() * {freq}) ELSE cos(y * 2 * pi() * {freq}) END AS z FROM g, range({D}) b(j))), "
        f"w0 AS (SELECT t, h.j, ({one})::DOUBLE AS v FROM (SELECT h.*, a.c, b.c AS way FROM h LEFT JOIN ce a ON a.k = h.k AND a.j = h.j LEFT JOIN ce b ON b.k = h.m AND b.j = h.j) h), "
        f"w AS MATERIALIZED (SELECT t, j, {last} AS v FROM w0)"
    )


_STREAM = f"{LINES}, {TOKENS}, s AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a)::BIGINT AS t FROM (SELECT doc_id, string_split(t, ',') AS a FROM lean))"


def _initial(version: int) -> str:
    cols = ", ".join(f"round(max(v) FILTER (WHERE j = {j}), 6) AS x{j}" for j in range(D))
    return f"WITH {_STREAM}, {_weights(version)}, n AS (SELECT t, count(*) AS n FROM s GROUP BY t) SELECT w.t::INT AS token_id, coalesce(any_value(n.n), 0)::BIGINT AS n, {cols} FROM w LEFT JOIN n ON n.t = w.t GROUP BY w.t"


def initial(spark, d, version):
    used = fx.streams(spark, d).select(F.explode("token_ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
    rows = embedding.initial(spark, D, version).join(used, "token_id", "left")
    return rows.select("token_id", F.coalesce("n", F.lit(0)).alias("n"), *[F.round(F.col("weight")[j], 6).alias(f"x{j}") for j in range(D)])


@query("m16_initial", _initial(1))
def m16(spark, d):
    """First weights of every id, beside how often streams hold it."""
    return initial(spark, d, 1)


@query("m16_equal_norms", _initial(2))
def m16_norms(spark, d):
    """The second version: all norms one, no mark of levels, slower waves."""
    return initial(spark, d, 2)


def _layer(name: str, out: str, n_in: int, i: str | None) -> str:
    key = f"'{name}.w:42:' || ({out} * {n_in} + {i})" if i else f"'{name}.b:42:' || {out}"
    return f"((2 * {_u(key)} - 1) / sqrt({n_in}))"


_WIDE = D + D_TYPE + D_COORD
_ERF = "list_sum(list_transform(range(30), lambda n: pow(-1, n) * pow(q, 2 * n + 1) / (factorial(n::INT)::DOUBLE * (2 * n + 1)))) * 2 / sqrt(pi())"
_FORWARD = (
    f"WITH {_STREAM}, {_weights(1)}, q AS (SELECT t, o, z, z / sqrt(2) AS q FROM (SELECT t, o, coalesce(l / 6.0::DOUBLE, 0) * {_layer('first', 'o', 3, '0')} + coalesce(x, 0) * {_layer('first', 'o', 3, '1')} + coalesce(y, 0) * {_layer('first', 'o', 3, '2')} + {_layer('first', 'o', 3, None)} AS z FROM f, range({D_COORD}) b(o))), "
    f"r AS (SELECT t, o, 0.5 * z * (1 + {_ERF}) AS z FROM q), "
    f"c AS (SELECT t, p.o, CASE WHEN t < 100 THEN 0 ELSE sum(z * {_layer('second', 'p.o', D_COORD, 'r.o')}) + any_value({_layer('second', 'p.o', D_COORD, None)}) END AS v FROM r, range({D_COORD}) p(o) GROUP BY t, p.o), "
    "k AS (SELECT t, CASE WHEN t < 10 THEN 0 WHEN t < 20 THEN 1 WHEN t < 30 THEN 2 WHEN t BETWEEN 30 AND 33 THEN 3 WHEN t BETWEEN 40 AND 55 THEN 4 WHEN t BETWEEN 60 AND 79 THEN 5 ELSE 6 END AS k FROM range(5561) r(t)), "
    f"a AS (SELECT t, j, v FROM w UNION ALL SELECT t, {D} + o, 2 * {_u(f'{chr(39)}kind:42:{chr(39)} || (k * {D_TYPE} + o)')} - 1 FROM k, range({D_TYPE}) b(o) UNION ALL SELECT t, {D + D_TYPE} + o, v FROM c), "
    f"p AS MATERIALIZED (SELECT t, o, sum(v * {_layer('projection', 'o', _WIDE, 'j')}) + any_value({_layer('projection', 'o', _WIDE, None)}) AS v FROM a, range({D}) b(o) GROUP BY t, o), "
    f"e AS (SELECT doc_id, pos, o, v + CASE WHEN o % 2 = 0 THEN sin(pos * exp(-o * ln(10000) / {D})) ELSE cos(pos * exp(-(o - 1) * ln(10000) / {D})) END AS v FROM s JOIN p USING (t)), "
    "m AS (SELECT doc_id, pos, avg(v) AS mean, var_pop(v) AS var FROM e GROUP BY ALL) "
    "SELECT doc_id, pos::INT AS pos, " + ", ".join(f"round(max((v - mean) / sqrt(var + 1e-5)) FILTER (WHERE o = {o}), 5) AS y{o}" for o in range(D)) + " FROM e JOIN m USING (doc_id, pos) GROUP BY doc_id, pos"
)


@query("m15_forward", _FORWARD)
def m15(spark, d):
    """A vector for every token of every order's stream."""
    m = embedding.model(embedding.initial(spark, D), D_TYPE, D_COORD)
    rows = embedding.forward(fx.streams(spark, d), m).select("doc_id", F.posexplode("embedding").alias("pos", "y"))
    return rows.select("doc_id", "pos", *[F.round(F.col("y")[o], 5).alias(f"y{o}") for o in range(D)])
