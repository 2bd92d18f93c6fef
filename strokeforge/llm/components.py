"""Connected components of a graph given as edges, without collecting anything.

Alternating large-star and small-star steps (Kiveris and others, 2014): each step links a
node's neighbours to the least of them, until every component is a star around its least node.
Every round's edges are stored, in files in keeping with their number, and the round before is
deleted.

Defined results: edges that repeat, in either direction, count once; an edge from a node to
itself is none; a table without edges gives an empty result. Nulls are not allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard_table, few, materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    links = down.join(least, "a")
    return links.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def components(edges: DataFrame, limit: int = 64) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b) of longs, but for roots; a stored table."""
    measure = lambda table: tuple(table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = measure(now)
    for _ in range(limit):
        if not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        old, before = now, state
        # A node has one lesser neighbour at least after a round, so edges never grow by more than the nodes.
        now = materialize(_small(_large(old).distinct()).distinct(), "edges", few(2 * state[0]))
        state = measure(now)
        discard_table(old)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")
