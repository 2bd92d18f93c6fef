"""Exact top-k search by inner product with an impact-ordered, score-at-a-time index.

Vectors are quantised to integers. The index is dealt into blocks of BLOCK vectors; within a
block every dimension has LEVELS posting segments, each with the vectors whose value lies in
one range. For a query, a segment's impact is the most that it can add to a score over the
least that the dimension adds to any: segments are processed by descending impact, whatever
their dimension, and add to each posting's score; a vector has at least what it was given so
far, and at most that and the impacts still to come. From time to time the k-th best lower bound
is held against every upper bound; processing stops only when
the vectors that can still reach it are few, which proves that no other can, and those are
rescored exactly. If it never becomes so the segments run out and all that can are rescored.

The stated queries meet every block of candidates as (block of queries, block of candidates)
cells; a cell returns k rows a query, and the best k of these are taken. The work, and what is
shuffled, grow with queries times vectors; blocks grow with the table up to BLOCK_BYTES.

Scores are exact whatever the size of the components: a cell computes in 64-bit floats while
every sum is an integer below 2**53, in 64-bit integers below 2**63, else in Python's integers.

Defined results: vectors that are null or hold null or non-finite components take no part;
missing components of a shorter vector count as zero; every row with an id that the queries'
divisor divides is a query, rows that repeat an id too, and a query's candidates are all rows
but itself, those of a null id too (no query has one); equal scores go to the smaller id, null
last; a score among the k best that 64 bits can't hold
is an error (OverflowError), never another value; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, materialize

K, EVERY, SCALE = 5, 50, 256
LEVELS = 8
#: Rows of a block of candidates: a 64th of all, within these bounds (the last as bytes of 64-bit numbers).
BLOCK, BLOCK_BYTES = 8192, 16 << 20
#: The bounds are looked at when what is still to come has fallen to these shares of all of it
#: and of itself at the last look; and the share of a block that is few.
FIRST_LOOK, NEXT_LOOK, FEW = 0.1, 0.7, 0.05


def taking_part(vectors: DataFrame) -> DataFrame:
    """uid (of the row), vec_id, v (the components as they are) of the vectors that take part."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return vectors.filter(good).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v"))


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles, in the narrowest numbers that hold every sum of a search exactly."""
    with np.errstate(over="ignore"):
        v = np.floor(x * SCALE)
    most = np.abs(v).max(initial=0.0)
    room = 4.0 * max(x.shape[1], 1) * most * most  # a score and its bounds
    if room < 2.0**53:
        return v
    if room < 2.0**62:
        return v.astype(np.int64)
    return np.array([[math.floor(Fraction(c) * SCALE) for c in row] for row in x.tolist()], object).reshape(x.shape)


class Index:
    """The segments of one block: values (m, d) of integers by rows."""

    def __init__(self, values: np.ndarray, levels: int = LEVELS):
        self.values = values
        if values.dtype == object:
            return
        self.segments = []  # dimension, postings, their values
        for d in range(values.shape[1]):
            order = np.argsort(values[:, d], kind="stable")
            self.segments += [(d, part, values[part, d]) for part in np.array_split(order, min(levels, len(order)))]
        self.dim = np.array([s[0] for s in self.segments], np.int64)
        self.lo = np.array([s[2][0] for s in self.segments], values.dtype)
        self.hi = np.array([s[2][-1] for s in self.segments], values.dtype)

    def search(self, query: np.ndarray, k: int, skip: int = -1):
        """(rows, scores) of all vectors that can be among the k best but skip, scored exactly."""
        m, dims = self.values.shape
        kind = self.values.dtype
        if kind == object:  # no bound is proof in rounded numbers: all are rescored
            members = np.delete(np.arange(m), skip) if skip >= 0 else np.arange(m)
            return members, np.array([sum(a * b for a, b in zip(row, query, strict=True)) for row in self.values[members].tolist()], object)
        q = query[self.dim]
        floor = np.full(dims, np.inf if kind == np.float64 else np.iinfo(np.int64).max, kind)
        np.minimum.at(floor, self.dim, np.minimum(q * self.lo, q * self.hi))
        gain = np.maximum(q * self.lo, q * self.hi) - floor[self.dim]
        order = np.argsort(-gain, kind="stable")
        # rest[n]: the most that the segments after the first n add to any one vector, by dimension.
        rest = np.zeros(len(order) + 1, kind)
        if len(order):
            by_dim = np.lexsort((np.arange(len(order)), self.dim[order]))
            drop = gain[order][by_dim]
            same = self.dim[order][by_dim][1:] == self.dim[order][by_dim][:-1]
            drop[:-1] -= np.where(same, drop[1:], 0)
            falls = np.empty_like(drop)
            falls[by_dim] = drop
            rest[:-1] = falls[::-1].cumsum()[::-1]
        low = np.full(m, floor.sum() if dims else 0, kind)  # what a vector scores at least
        members, look = np.arange(m), rest[0] * FIRST_LOOK
        for n, s in enumerate(order.tolist(), 1):
            d, postings, values = self.segments[s]
            low[postings] += query[d] * values - floor[d]
            if rest[n] <= look:
                look = rest[n] * NEXT_LOOK
                able = np.delete(low, skip) if skip >= 0 else low
                if len(able) <= k:
                    break
                bar = np.partition(able, len(able) - k)[len(able) - k]
                members = np.flatnonzero(low + rest[n] >= bar)
                if len(members) <= max(4 * k, FEW * m):
                    break
        members = members[members != skip]
        return members, self.values[members] @ query


def _matrix(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = rows.combine_chunks()
    counts = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), width))
    row = np.repeat(np.arange(len(rows)), counts)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = rows.flatten().to_numpy()
    return out


RESULT = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("other", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def search_cell(k: int, width: int):
    def search(table: pa.Table) -> pa.Table:
        side, uid = (table.column(c).to_numpy() for c in ("side", "uid"))
        nameless, ids = table.column("vec_id").is_null().to_numpy(), table.column("vec_id").fill_null(0).to_numpy()
        values = quantised(_matrix(table.column("v"), width))
        mine, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: list[tuple] = []
        if len(mine) and len(asked):
            mine = mine[np.argsort(uid[mine])]
            own, index = uid[mine], Index(values[mine])
            for q in asked:
                at = int(np.searchsorted(own, uid[q]))
                rows, scores = index.search(values[q], k, at if at < len(own) and own[at] == uid[q] else -1)
                others, last = ids[mine[rows]], nameless[mine[rows]]
                if scores.dtype == object:
                    best = sorted(range(len(rows)), key=lambda i: (-scores[i], last[i], others[i], own[rows[i]]))[:k]
                    if any(not -(1 << 63) <= scores[i] < 1 << 63 for i in best):
                        raise OverflowError(f"a score of vector {ids[q]} needs over 64 bits")
                else:
                    best = np.lexsort((own[rows], others, last, -scores))[:k]
                out += [(int(uid[q]), int(ids[q]), int(own[rows[i]]), None if last[i] else int(others[i]), int(scores[i])) for i in best]
        found = pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], schema=RESULT)
        give_back()
        return found

    return search


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int | None = None, queries: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each vector whose id every divides."""
    rows = materialize(taking_part(vectors), "topk-vectors")
    n, width, asked = rows.agg(F.count("*"), F.max(F.size("v")), F.count_if(F.col("vec_id") % every == 0)).first()
    most = max(1, BLOCK_BYTES // (8 * max(width or 0, 1)))
    block = block or min(most, max(BLOCK, n // 64))
    cb, qb = max(1, -(-n // block)), max(1, -(-asked // (queries or min(most, max(BLOCK // 2, n // 64)))))
    dealt = lambda salt, parts: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(parts)).cast("int")
    mine = rows.select(dealt(1, cb).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"), F.lit(0).alias("side"), "uid", "vec_id", "v")
    ask = rows.filter(F.col("vec_id") % every == 0)
    ask = ask.select(F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("c"), dealt(2, qb).alias("q"), F.lit(1).alias("side"), "uid", "vec_id", "v")
    found = mine.unionByName(ask).groupBy("c", "q").applyInArrow(search_cell(k, width or 0), "uid long, query_id long, other long, vec_id long, score long")
    best = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.uid <> c.uid),
r AS (SELECT uid, query_id, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
