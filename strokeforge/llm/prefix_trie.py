"""Conversation prefix trie by preorder intervals.

A node is a distinct sequence of the first turns of a conversation. Its key is the exclusive-or
of two 64-bit hashes of (place, turn), so keys are running folds and no conversation is ever
gathered. Conversations are ranked in lexicographic order of the edges at which their paths
branch (then by length): members of every node then stand together. A node is numbered at its
first member, in preorder; the end of its subtree is the last node that its last member or one
before it numbers. Leaves and savings of subtrees are differences of running sums over that
numbering. All rankings and sums are folds over ranges (see scans), so neither a hot node nor a
hot conversation is held by one task. Conversations that end at a node are hashed as they stream
by, in order, as a SHA-256 needs; what one task reads are joined runs of ids.

Defined results: a null role or text is empty; turns are in order of turn (null first), then of
their MD5; rows that repeat are turns of their own; rows of a null conv_id take no part; an
empty table has no node, not even the root; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, materialize
from .scans import ranged, running

#: A conversation takes fewer than LEADS first turns from the first one of its SPAN.
LEADS, SPAN = 6, 100
#: Ids that are joined to one text before they are hashed.
RUN = 10_000
KEY = ["k1", "k2"]


def _turns(conversations: DataFrame) -> DataFrame:
    """c, i (from 1), m (the turn's MD5) and code (code points of its text) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("m"), F.length(text).cast("long").alias("code")
    )
    return running(ranged(turns, ["c", "t", "m"]), ["c"], ["c", "t", "m"], {"i": ("sum", F.lit(1).cast("long"))}).select("c", "i", "m", "code")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """c, total (its rebuilt turns), pos, m, code of every rebuilt turn, and a row of pos 0 for each conversation.

    The first h turns of a conversation c, h = crc32(c) % LEADS, are those of c - c % SPAN.
    """
    turns = materialize(_turns(conversations), "trie-turns")
    bases = turns.filter(f"i < {LEADS} AND c % {SPAN} = 0").groupBy(F.col("c").alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "m", "code"))).alias("lead"))
    convs = turns.groupBy("c").agg(F.count("*").alias("n")).withColumns({"h": F.crc32(F.col("c").cast("string")) % LEADS, "b": F.expr(f"c - c % {SPAN}")})
    convs = convs.join(bases, "b", "left").withColumn("lead", F.expr("slice(lead, 1, int(h))"))
    nb = F.coalesce(F.array_size("lead"), F.lit(0))
    convs = materialize(convs.select("c", "n", "h", "lead", nb.cast("long").alias("nb"), (nb + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "trie-conversations")
    tops = convs.select("c", "total", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("m"), F.lit(0).cast("long").alias("code"))
    leads = convs.select("c", "total", F.explode("lead").alias("x")).select("c", "total", F.col("x.i").alias("pos"), "x.m", "x.code")
    own = hot_join(turns, convs.select("c", "n", "h", "nb", "total"), ["c"], "n", turns.count()).filter("i > h")
    return tops.unionByName(leads).unionByName(own.select("c", "total", (F.col("nb") + F.col("i") - F.col("h")).alias("pos"), "m", "code"))


def _keyed(turns: DataFrame) -> DataFrame:
    """c, total, pos, code, KEY of the node that the turn ends at and p1, p2 of its parent; a stored table."""
    top = F.col("pos") == 0
    rows = turns.select("c", "total", "pos", "code", F.when(top, 0).otherwise(F.xxhash64("pos", "m")).alias("h1"), F.when(top, 0).otherwise(F.xxhash64("m", F.lit(LEADS), "pos")).alias("h2"))
    rows = running(ranged(rows, ["c", "pos"]), ["c"], ["c", "pos"], {"k1": ("xor", F.col("h1")), "k2": ("xor", F.col("h2"))})
    return materialize(rows.select("c", "total", "pos", "code", *KEY, F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2")), "trie-rows")


def _nodes(rows: DataFrame) -> DataFrame:
    """KEY, depth, conv, n (members), code, kids, parent (its conv), sibs (children of the parent) of every node; a stored table."""
    nodes = rows.groupBy(*KEY).agg(F.max("pos").alias("depth"), F.min("c").alias("conv"), F.count("*").alias("n"), F.max("code").alias("code"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = materialize(nodes, "trie-nodes")
    kids = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("kids"))
    nodes = materialize(nodes.join(kids, KEY, "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long"))), "trie-nodes")
    above = nodes.filter("kids > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"), F.col("kids").alias("sibs"))
    below = hot_join(nodes.filter("depth > 0"), above, ["p1", "p2"], "sibs", nodes.count())
    root = nodes.filter("depth = 0").withColumns({"parent": F.lit(None).cast("long"), "sibs": F.lit(0).cast("long")})
    return materialize(below.unionByName(root).drop("p1", "p2"), "trie-nodes")


def _spans(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """KEY, first and last: the ranks of a node's first and last member in lexicographic order."""
    forks = nodes.filter("sibs > 1 OR depth = 0").select(*KEY, "n")
    edges = hot_join(rows.select("c", "total", "pos", *KEY), forks, KEY, "n", rows.count())
    paths = edges.groupBy("c").agg(F.expr("sort_array(collect_list(struct(pos, k1, k2)))").alias("path"), F.max("total").alias("total")).withColumn("all", F.lit(0))
    order = ["path", "total", "c"]
    ranks = running(ranged(paths, order), ["all"], order, {"rank": ("sum", F.lit(1).cast("long"))})
    ranks = materialize(ranks.select("c", "rank", (F.col("total") + 1).alias("length")), "trie-ranks")
    told = hot_join(rows.select("c", *KEY), ranks, ["c"], "length", rows.count())
    return told.groupBy(*KEY).agg(F.min("rank").alias("first"), F.max("rank").alias("last"))


def _subtrees(nodes: DataFrame) -> DataFrame:
    """KEY, preorder, subtree_end, leaves, saved of nodes (with first and last)."""
    own = {"one": F.lit(1).cast("long"), "leaf": (F.col("kids") == 0).cast("long"), "saves": (F.col("n") - 1) * F.col("code")}
    enter = nodes.select(*KEY, F.col("first").alias("rank"), F.lit(0).alias("role"), "depth", *[c.alias(name) for name, c in own.items()])
    leave = nodes.select(*KEY, F.col("last").alias("rank"), F.lit(1).alias("role"), "depth", *[F.lit(0).cast("long").alias(name) for name in own])
    order = ["rank", "role", "depth", *KEY]
    sums = running(ranged(enter.unionByName(leave).withColumn("all", F.lit(0)), order), ["all"], order, {f"s_{name}": ("sum", F.col(name)) for name in own})
    at = lambda role, c: F.max(F.when(F.col("role") == role, c))
    part = lambda name: at(1, F.col(f"s_{name}")) - at(0, F.col(f"s_{name}") - F.col(name))
    return sums.groupBy(*KEY).agg(at(0, F.col("s_one")).alias("preorder"), at(1, F.col("s_one")).alias("subtree_end"), part("leaf").alias("leaves"), part("saves").alias("saved"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, k2, sha of runs (k1, k2, text) in order: the SHA-256 of each key's runs, joined by commas."""
    now, digest = None, None
    for batch in batches:
        done = []
        for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text")), strict=True):
            if (k1, k2) != now:
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = (k1, k2), hashlib.sha256(text.encode())
            else:
                digest.update(f",{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["k1", "k2", "sha"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([digest.hexdigest()])], ["k1", "k2", "sha"])


def _ends(rows: DataFrame) -> DataFrame:
    """KEY and sha, the digest of the conversations that end there, of every node where some do."""
    ends = ranged(rows.filter("pos = total").select(*KEY, "c"), [*KEY, "c"])
    nth = F.row_number().over(Window.partitionBy("_part", *KEY).orderBy("c"))
    runs = ends.withColumn("run", F.floor((nth - 1) / RUN)).groupBy(*KEY, "_part", "run").agg(F.expr("array_join(transform(sort_array(collect_list(c)), x -> string(x)), ',')").alias("text"))
    runs = runs.repartition(*KEY).sortWithinPartitions(*KEY, "_part", "run")
    return runs.select(*KEY, "text").mapInArrow(_digests, "k1 long, k2 long, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node: its preorder number and subtree_end, and the columns of the query."""
    rows = _keyed(rebuilt(conversations))
    nodes = _nodes(rows)
    nodes = materialize(nodes.join(_spans(rows, nodes), KEY), "trie-spans")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes.join(_subtrees(nodes), KEY).join(_ends(rows), KEY, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", none).alias("ends_sha256"), "preorder", "subtree_end",
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of conversations' trie."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("preorder", "subtree_end")


SQL = f"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS crc),
o AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT c, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % {LEADS} AS h FROM o, k),
r AS (SELECT h.c, list_concat(coalesce(b.turns[:h.h], []), h.turns[h.h + 1:]) AS path FROM h LEFT JOIN o b ON b.c = h.c - h.c % {SPAN}),
m AS (SELECT c, d AS depth, path[:d] AS node, d = len(path) AS ends FROM r, unnest(range(len(path) + 1)) AS t(d)),
n AS (SELECT depth, node, min(c) AS conv, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS last FROM m GROUP BY depth, node),
p AS (SELECT n.*, a.conv AS parent FROM n LEFT JOIN n a ON a.depth = n.depth - 1 AND a.node = n.node[:n.depth - 1]),
w AS (SELECT *, (n - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(node[depth].x) END AS saves, (SELECT count(*) FROM n b WHERE b.depth = p.depth + 1 AND b.node[:p.depth] = p.node) AS kids FROM p)
SELECT a.conv AS conv_id, a.depth, any_value(a.parent) AS parent_conv_id, any_value(a.n) AS n_convs, any_value(a.kids) AS n_children,
       count(*) FILTER (WHERE b.kids = 0) AS n_leaves, sum(b.saves)::BIGINT AS saved_tokens, sha256(any_value(a.last)) AS ends_sha256
FROM w a JOIN w b ON b.depth >= a.depth AND b.node[:a.depth] = a.node GROUP BY a.conv, a.depth, a.node
"""
