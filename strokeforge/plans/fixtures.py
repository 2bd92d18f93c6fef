"""Drawings derived from the relational tables, for queries that SQL can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.path import COMMANDS, cmd


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores, if its files are fewer: drawing makes much of few bytes."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df


def points(spark: SparkSession, d: str) -> DataFrame:
    """event_id, x, y; some outside the canvas."""
    return table(spark, d, "events").select("event_id", F.col("value").alias("x"), ((F.col("event_id") * 37) % 300 + 0.25).cast("double").alias("y"))


def polylines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, pts, elements: a line through the items of each order."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 6).alias("x"), (F.col("l_extendedprice") / 350).alias("y")).alias("p"))
    docs = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list("p")).alias("p"))
    docs = docs.select("doc_id", F.expr("transform(p, q -> named_struct('x', q.x, 'y', q.y))").alias("pts"))
    first = cmd("M", ["p.x", "p.y"], "p.x", "p.y", "p.x", "p.y")
    line = cmd("L", ["p.x", "p.y"], "pts[i - 1].x", "pts[i - 1].y", "p.x", "p.y")
    return docs.withColumn("elements", F.expr(f"cast(array(transform(pts, (p, i) -> IF(i = 0, {first}, {line}))) AS ARRAY<{COMMANDS}>)"))


def cubics(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, cmds: a move and ten cubics through 31 of a vector's 32 points."""
    at = lambda n: f"((cast(embedding[{n}] AS DOUBLE) + 0.6D) * 250D)"
    pt = lambda i, k: (at(f"6 * {i} + {2 * k}"), at(f"6 * {i} + {2 * k + 1}"))
    (sx, sy), (ax, ay), (bx, by), (cx, cy) = (pt("i", k) for k in range(4))
    curve = cmd("C", [ax, ay, bx, by, cx, cy], sx, sy, cx, cy)
    move = cmd("M", [at("0"), at("1")], at("0"), at("1"), at("0"), at("1"))
    return spread(table(spark, d, "embeddings")).select("vec_id", F.expr(f"cast(concat(array({move}), transform(sequence(0, 9), i -> {curve})) AS {COMMANDS})").alias("cmds"))


#: SQL for both engines: what the drawing of a part holds.
PART = {
    "k": "p_partkey", "tx": "p_partkey % 5", "ty": "p_partkey % 3", "kind": "p_partkey % 4", "x": "10 + p_partkey % 150", "y": "10 + (p_partkey * 3) % 150",
    "w": "p_size % 60 + 20", "h": "p_size % 40 + 20", "cx": "60 + p_partkey % 180", "cy": "60 + (p_partkey * 7) % 180", "r": "p_size % 30 + 2", "rx": "p_size % 20 + 30", "ry": "p_size % 15 + 2",
}


def drawings(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, svg: one circle, rectangle, ellipse or closed path for each part, in a moved group."""
    p = spread(table(spark, d, "part")).selectExpr(*[f"cast({v} AS INT) AS {n}" for n, v in PART.items()])
    shape = (
        "CASE kind WHEN 0 THEN concat('<circle cx=\"', cx, '\" cy=\"', cy, '\" r=\"', r, '\"/>') WHEN 1 THEN concat('<rect x=\"', x, '\" y=\"', y, '\" width=\"', w, '\" height=\"', h, '\"/>') "
        "WHEN 2 THEN concat('<ellipse cx=\"', cx, '\" cy=\"', cy, '\" rx=\"', rx, '\" ry=\"', ry, '\"/>') ELSE concat('<path d=\"m', x, ',', y, 'h', w, 'v', h, 'h-', w, 'z\"/>') END"
    )
    return p.select(F.col("k").cast("long").alias("doc_id"), F.expr(f"concat('<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"300\" height=\"300\"><!-- <text> --><g id=\"g', k, '\" transform=\"translate(', tx, ' ', ty, ')\">', {shape}, '</g></svg>')").alias("svg"))


def layouts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, svg: a row of equal circles for each nation, 2 to 6 of them, 40 apart."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), (F.col("n_nationkey") % 5 + 2).cast("int").alias("n"))
    one = "concat('<circle cx=\"', 30 + 40 * i, '\" cy=\"', 50 + doc_id * 5, '\" r=\"', 8 + doc_id % 7, '\"/>')"
    return n.select("doc_id", "n", F.expr(f"concat('<svg>', array_join(transform(sequence(0, n - 1), i -> {one}), ''), '</svg>')").alias("svg"))


def streams(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, token_ids: the lean streams of polylines."""
    from ..operators import codec

    return codec.l1(polylines(spark, d), lean=True).select("doc_id", "token_ids")
