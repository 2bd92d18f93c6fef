"""SimHash near-dedup by exact, tiled comparison.

Fingerprints: 64 bits of majority votes of the XXH64 of three-word shingles. Distinct
fingerprints are split by their count of one bits and, within a count, into blocks; a cell
compares one block with another whose count differs by the radius at most, in tiles: numpy's
exclusive or and bit count of a tile of sorted fingerprints against those rows of the other
block whose counts of bits, by quarter words, can be within the radius of the tile's range.
Rows and tiles beyond it are skipped, which loses nothing: a count differs by no more than
the bits do. A cell returns a spanning forest of its links, never its pairs; the forests'
components are found by star contraction over the cluster.

Defined results: a null or empty text has fingerprint zero, which links like any other;
equal texts share a fingerprint; rows that repeat a doc_id are each returned; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, few, give_back, hot_join, materialize, slices, stored
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
LEFT, RIGHT = 256, 1 << 14
#: Rows of a block: about a sixteenth of all fingerprints, within these bounds (2 MB at most).
BLOCK_LEAST, BLOCK_MOST = 4096, 1 << 18
#: Hashes whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    k = max(1, len(words) - shingle + 1)
    last = ends[-k:].tolist()
    ones = np.zeros(64, np.int64)
    starts = starts[:k].tolist()
    for i in range(0, k, CHUNK):
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], last[i : i + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            prints = np.array([fingerprint(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view("<i8"), pa.int64())], names=["doc_id", "fp"])
        give_back()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fp).view("<u2").reshape(-1, 4)).astype(np.int16)


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Link nodes a with nodes b in the forest root, whose trees are flat before and after."""
    while True:
        a, b = root[a], root[b]
        new = a != b
        if not new.any():
            return
        a, b = a[new], b[new]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> np.ndarray:
    """Spanning links (n, 2) of the values in left (with right, or among themselves) at most radius bits apart."""
    both = np.unique(left if right is None else np.concatenate([left, right]))
    if len(both) < 2:
        return np.empty((0, 2), "<u8")

    def ordered(x: np.ndarray):
        x = np.unique(x)
        q = _quarters(x)
        by = np.lexsort(q.T[::-1])
        return x[by], q[by], np.searchsorted(both, x[by])

    a, qa, na = ordered(left)
    b, qb, nb = (a, qa, na) if right is None else ordered(right)
    root = np.arange(len(both))
    for i in range(0, len(a), LEFT):
        tile, lo, hi = a[i : i + LEFT], qa[i : i + LEFT].min(0), qa[i : i + LEFT].max(0)
        for j in range(i if right is None else 0, len(b), RIGHT):
            q = qb[j : j + RIGHT]
            near = np.flatnonzero((np.maximum(lo - q, 0) + np.maximum(q - hi, 0)).sum(1) <= radius)
            if not len(near):
                continue
            bits = np.bitwise_count(tile[:, None] ^ b[j : j + RIGHT][near][None, :])
            r, c = np.nonzero(bits <= radius)
            _join(root, na[i + r], nb[j + near[c]])
    child = np.flatnonzero(root != np.arange(len(both)))
    return np.stack([both[child], both[root[child]]], 1)


def _cell(table: pa.Table) -> pa.Table:
    side, fp = table.column("side").to_numpy(), table.column("fp").to_numpy().view("<u8")
    one = bool((side == 2).any())
    links = forest(fp, None) if one else forest(fp[side == 0], fp[side == 1])
    out = pa.table({"a": links[:, 0].copy().view("<i8"), "b": links[:, 1].copy().view("<i8")})
    give_back()
    return out


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a, b whose components are those of all links among the values of fp."""
    cells = dealt_cells(distinct.select("fp", F.bit_count("fp").cast("int").alias("p")), radius)
    return cells.groupBy("p", "i", "q", "j").applyInArrow(_cell, "a long, b long")


def dealt_cells(distinct: DataFrame, radius: int, key: str = "fp", most=lambda p: BLOCK_MOST) -> DataFrame:
    """Rows with a class p, dealt by key to cells (p, i, q, j) so that any two whose classes differ by radius at most meet in one.

    most: how many rows a block of a class may have.
    """
    spark, columns = distinct.sparkSession, [c for c in distinct.columns if c != "p"]
    classes = {r["p"]: r["n"] for r in distinct.groupBy("p").agg(F.count("*").alias("n")).collect()}  # few classes: counts of bits, or logarithms of sizes
    size = max(BLOCK_LEAST, sum(classes.values()) // 16)
    blocks = {p: -(-n // min(size, most(p))) for p, n in classes.items()}
    # For each class, how many blocks the classes above it have: a constant number of rows.
    near = spark.createDataFrame(
        [(p, blocks[p], [(q, blocks.get(q, 0)) for q in range(p, p + radius + 1)], [(q, blocks.get(q, 0)) for q in range(p - radius, p)]) for p in blocks] or [(0, 1, [(0, 0)], [(0, 0)])],
        "p int, own int, up array<struct<q:int,n:int>>, down array<struct<q:int,n:int>>",
    )
    rows = distinct.join(F.broadcast(near), "p").withColumn("i", F.pmod(F.xxhash64(key), "own").cast("int"))

    def dealt(side: str, cell):
        out = rows.withColumn("o", F.explode(side)).filter("o.n > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("o.n") - 1)))
        return out.select(*[c.alias(n) for n, c in zip(("p", "i", "q", "j"), cell, strict=True)], *columns, F.col("p").alias("_p"), F.col("i").alias("_i"))

    me, it = (F.col("p"), F.col("i")), (F.col("o.q"), F.col("j"))
    up = dealt("up", (*me, *it)).filter("q > p OR j >= i").withColumn("side", F.when(F.expr("p = q AND i = j"), 2).otherwise(0))
    down = dealt("down", (*it, *me)).withColumn("side", F.lit(1))
    same = dealt("up", (*it, *me)).filter("p = q AND i < j").withColumn("side", F.lit(1))
    return up.unionByName(down).unionByName(same).select("p", "i", "q", "j", "side", *columns)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    prints = stored(fingerprints(docs))
    total = prints.count()
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "simhash-distinct", few(total))
    stars = components(links(distinct.select("fp"), radius))
    # The least fingerprint stands for a component; it has no row in stars.
    linked = stars.select(F.col("node").alias("fp"), "root").unionByName(stars.select(F.col("root").alias("fp"), "root").distinct())
    linked = materialize(linked.join(distinct.select("fp", "doc"), "fp"), "simhash-linked", few(2 * stars.count()))
    met = linked.count()
    least = materialize(linked.groupBy("root").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "simhash-least", few(met))
    known = hot_join(linked.select("fp", "root"), least, ["root"], "n", met).select("fp", "least")
    named = distinct.join(known, "fp", "left").select("fp", "copies", F.coalesce("least", "doc").alias("component_id"))
    out = hot_join(prints, materialize(named, "simhash-named", few(total)), ["fp"], "copies", total)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: that of the least doc_id, then of the least hash of the text.

    Texts are linked by similar.py (five-word shingles, similarity 0.8), not by op8's radius. A
    null doc_id comes before all; a null text counts as empty, and texts without words are one
    group; of rows that repeat both doc_id and text one stays; an empty table gives an empty one.
    """
    from .similar import representatives

    kept, repeated = representatives(docs.select("doc_id", "text"))
    keys = ["_oid", "_th"]
    rows = docs.withColumn("_oid", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))).withColumn("_th", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = kept.toDF(*keys).hint("shuffle_hash")
    if repeated.isEmpty():
        return rows.join(kept, keys, "left_semi").select(*docs.columns)
    repeated = repeated.toDF(*keys, "copies")
    once = rows.join(kept.join(repeated, keys, "left_anti"), keys, "left_semi").select(*docs.columns)
    total = repeated.agg(F.sum("copies")).first()[0]
    again = hot_join(rows.withColumn("_row", F.struct(*docs.columns)).select(*keys, "_row"), repeated, keys, "copies", total)
    first = again.groupBy(*keys).agg(F.first("_row").alias("_row"))  # combined before it is shuffled
    return once.unionByName(first.select("_row.*"))
