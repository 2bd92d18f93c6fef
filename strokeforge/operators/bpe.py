"""Byte-pair merges over token streams: counting, learning, encoding, decoding.

Learning counts pairs of neighbours once, with a partial and a final sum, and then by what changes:
each round takes the best pairs that can be merged together, rewrites the streams that hold one,
and adds the difference of these streams' pairs. Distinct streams count once, with their number.
Encoding uses an Arrow map with a heap over linked positions; decoding is a lookup of whole
expansions.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import ids
from ..functions.sqlgen import let, scan
from ..sources.shared import discard_table, materialize

PROTECTED = (1, 2, 3)
#: Pairs that are merged in one round at most.
BATCH = 16


def pair_counts(streams: DataFrame, tokens: str = "token_ids", protected=PROTECTED, weight: str = "1L") -> DataFrame:
    """a, b, n: how often b follows a, overlapping occurrences included, without protected ids."""
    keep = ", ".join(map(str, protected))
    pairs = f"filter(transform(sequence(0, size({tokens}) - 2), i -> named_struct('a', {tokens}[i], 'b', {tokens}[i + 1])), p -> p.a NOT IN ({keep}) AND p.b NOT IN ({keep}))"
    each = streams.filter(f"size({tokens}) > 1").select(F.expr(weight).alias("w"), F.explode(F.expr(pairs)).alias("p"))
    return each.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("w").alias("n"))


def best_pair(counts: DataFrame) -> DataFrame:
    """The most frequent pair; of equals the least a, then the least b."""
    return counts.orderBy(F.desc("n"), "a", "b").limit(1)


def merged(tokens: str, a: int, b: int, new: int) -> str:
    """SQL: tokens with each non-overlapping a, b from the left replaced by new."""
    return merged_all(tokens, [[a, b, new]])


def merged_all(tokens: str, merges: list[list[int]]) -> str:
    """SQL: tokens with each a, b of merges, none of which overlaps another, replaced by its new id."""
    none = "cast(array() AS ARRAY<INT>)"
    # A token is held back until the next one shows whether both are merged.
    held = lambda s: f"IF({s}.a IS NULL, {none}, array({s}.a))"
    hit = lambda s: "CASE " + " ".join(f"WHEN {s}.a = {a} AND t = {b} THEN {new}" for a, b, new in merges) + " END"
    step = lambda s: let({"hit": hit(s)}, f"named_struct('st', named_struct('a', IF(hit IS NULL, t, NULL)), 'out', IF(hit IS NULL, {held(s)}, array(hit)))", "struct<st:struct<a:int>,out:array<int>>")
    return scan(tokens, "t", "named_struct('a', cast(NULL AS INT))", "struct<a:int>", "int", step, held)


def independent(ranked: list[tuple[int, int, int]], most: int, whole: bool) -> list[tuple[int, int]]:
    """The first pairs of ranked (a, b, n) that can be merged at once, with what merging them one by one gives.

    No pair of a batch meets another (so none takes from another's count), and the least of them is
    more frequent than any other pair. A pair with a new id is no more frequent than one that it
    takes the place of, which is none of the batch: so none comes before the batch is through.
    whole: whether ranked holds every pair that counts. One pair can always be merged.
    """
    met, best = [], 1
    for i, (a, b, n) in enumerate(ranked[:most]):
        if i and (a == b or met[0][0] == met[0][1] or any(b == c or a == d for c, d in met)):
            break
        met.append((a, b))
        if (whole and i + 1 == len(ranked)) or (i + 1 < len(ranked) and ranked[i + 1][2] < n):
            best = i + 1
    return met[:best]


def learn(streams: DataFrame, n_merges: int, vocab: int = ids.VOCAB, min_freq: int = 2, protected=PROTECTED, tokens: str = "token_ids") -> list[list[int]]:
    """[a, b, new id] in the order of priority, at most n_merges.

    Pairs are counted once. Each round merges the first pairs that do not touch each other, and
    changes the counts by those of the streams that hold one of them: pairs before and after.
    """
    protected = tuple(protected) or PROTECTED
    rows = streams.groupBy(F.col(tokens).alias("t")).agg(F.count("*").alias("w"))
    rows = materialize(rows.select("t", F.lit(None).cast("array<int>").alias("u"), "w"), "bpe")
    counts = materialize(pair_counts(rows, "t", protected, "w"), "bpe-pairs")
    out: list[list[int]] = []
    while len(out) < n_merges:
        top = [tuple(r) for r in counts.filter(F.col("n") >= min_freq).orderBy(F.desc("n"), "a", "b").limit(BATCH + 1).select("a", "b", "n").collect()]
        batch = [[a, b, vocab + len(out) + i] for i, (a, b) in enumerate(independent(top, min(BATCH, n_merges - len(out)), len(top) <= BATCH))]
        if not batch:
            break
        out += batch
        if len(out) == n_merges:
            break
        holds = " OR ".join(f"(array_contains(t, {a}) AND array_contains(t, {b}))" for a, b, _ in batch)
        now = rows.select(F.coalesce("u", "t").alias("t"), "w").withColumn("u", F.expr(f"IF({holds}, {merged_all('t', batch)}, NULL)"))
        now = materialize(now.select("t", F.expr("IF(u = t, NULL, u)").alias("u"), "w"), "bpe")
        touched = now.filter("u IS NOT NULL")
        change = pair_counts(touched, "u", protected, "w").unionByName(pair_counts(touched, "t", protected, "-w"))
        following = materialize(counts.unionByName(change).groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 0"), "bpe-pairs")
        for old in (rows, counts):
            discard_table(old)
        rows, counts = now, following
    return out


def encode_stream(t: list[int], rank: dict[tuple[int, int], int], base: int, protected=PROTECTED) -> list[int]:
    """Repeatedly the leftmost pair of the least rank; the id that replaces it is base + rank."""
    n = len(t)
    t, nxt, prv = list(t), list(range(1, n + 1)), list(range(-1, n - 1))

    def offer(i: int) -> None:
        if i >= 0 and nxt[i] < n:
            a, b = t[i], t[nxt[i]]
            r = rank.get((a, b))
            if r is not None and a not in protected and b not in protected:
                heapq.heappush(heap, (r, i, a, b))

    heap: list = []
    for i in range(n):
        offer(i)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i] if t[i] is not None else n
        if j >= n or t[i] != a or t[j] != b:
            continue
        t[i], t[j], nxt[i] = base + r, None, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        offer(prv[i])
        offer(i)
    return [x for x in t if x is not None]


def encode(df: DataFrame, merges: list, tokens: str = "token_ids", base: int = ids.VOCAB) -> DataFrame:
    """df with its streams encoded; null stays null."""
    rank = {(m[0], m[1]): i for i, m in reversed(list(enumerate(merges)))}
    at = df.columns.index(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([None if t is None else encode_stream(t, rank, base) for t in batch.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def from_manifest(manifest: dict) -> list[list[int]]:
    """The merges of a manifest; an error where it has none."""
    if not manifest.get("merges"):
        raise EngineError("INVALID_REQUEST", f"manifest {manifest.get('vocab_id')} has no merges")
    return manifest["merges"]


def expansions(merges: list) -> dict[int, list[int]]:
    """new id -> the ids below that it stands for, all the way down."""
    out: dict[int, list[int]] = {}
    pairs = {m[2]: (m[0], m[1]) for m in merges}
    for m in merges:
        stack, flat = [m[2]], []
        while stack:
            t = stack.pop()
            if t in pairs:
                stack += reversed(pairs[t])
            else:
                flat.append(t)
        out[m[2]] = flat
    return out


def expanded(tokens: str, merges: list) -> str:
    """SQL: tokens with merged ids replaced by their expansions, which an array has at the place of the id."""
    if not merges:
        return tokens
    full = expansions(merges)
    base, top = min(full), max(full)
    table = "array(" + ", ".join(f"array({', '.join(map(str, full.get(k, [k])))})" for k in range(base, top + 1)) + ")"
    return f"IF(exists({tokens}, t -> t >= {base}), element_at(transform(array({table}), mm -> flatten(transform({tokens}, t -> IF(t BETWEEN {base} AND {top}, get(mm, t - {base}), array(t))))), 1), {tokens})"


def decode(df: DataFrame, merges: list, tokens: str = "token_ids") -> DataFrame:
    return df.withColumn(tokens, F.expr(expanded(tokens, merges)))


def corpus_streams(spark, path: str, limit: int | None = None, lean: bool = False) -> DataFrame:
    """path, token_ids of the SVG files of a folder in the order of their paths; those that fail are left out."""
    from ..sources.files import read_files
    from . import codec

    files = read_files(spark, path).select("path", "svg")
    if limit is not None:
        files = files.orderBy("path").limit(limit)
    return codec.l1(codec.parsed(files), lean).filter("error IS NULL").select("path", "token_ids")
