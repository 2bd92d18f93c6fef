"""Near copies by SimHash at a wide radius, each link held to an exact Jaccard similarity.

Nodes are distinct sets of five-word shingles (by XXH64). Two sets of similarity LEAST differ in
size by a factor of 1 / LEAST at most, so nodes are split by the logarithm of their size and only
equal and adjoining classes are compared, in cells of blocks as in simhash: tiles of exclusive or
and bit counts, skipped where sizes or counts of bits are too far apart. Candidates have
fingerprints at most RADIUS bits apart; a candidate is a link if the Jaccard similarity of its
two sets is LEAST or more. Fingerprints of a pair at 0.8 are about 10 bits apart, so RADIUS is
wide; pairs beyond it are missed (README).

A second exclusive or in the same tile rejects most candidates that are no links and loses none:
of each set the parity of the number of shingles in each of many buckets, as many as it has
shingles or more. Every bit in which two parities differ stands for at least one shingle that
one set has alone, and two sets of similarity 0.8 have a ninth of their sizes' sum of these at
most. A cell folds all its parities to the fewest buckets that one of its rows has.

The first round takes a spanning forest of each cell's candidates (and one of those that the
parities say are links), so that a large group of copies is one component before the second,
which takes every candidate between different components. Only documents of the forests have
their shingles fetched, once.

Defined results: a null text counts as empty; texts without words are alike; a null doc_id comes
before all; rows that repeat are each returned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, give_back, hot_join, materialize, slices, stored, text_or_empty
from .components import components
from .simhash import LEFT, RIGHT, SEED, dealt_cells

SHINGLE, RADIUS, LEAST = 5, 20, 0.8
#: Sizes of a class differ by less than this factor; a little over 1 / LEAST, against rounding.
STEP = 1.26
#: Buckets of parities: a power of two within these bounds.
FEWEST, MOST = 1 << 10, 1 << 17
#: Rows of a block at most, and their bytes.
BLOCK_MOST, BLOCK_BYTES = 1 << 17, 16 << 20


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of words, with repeats."""
    from xxhash import xxh64_intdigest as h

    w = text.lower().split()
    return np.array([h(b" ".join(w[i : i + shingle]), SEED) for i in range(max(1, len(w) - shingle + 1))] if w else [], "<u8")


def vote(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def parities(hashes: np.ndarray) -> bytes:
    """The parities of the numbers of distinct hashes in so many buckets as buckets() says, as bits."""
    m = buckets(len(hashes))
    return np.packbits(np.bincount((hashes % np.uint64(m)).astype(np.int64), minlength=m) & 1).tobytes()


def buckets(n: int) -> int:
    return min(MOST, max(FEWEST, 1 << max(n - 1, 0).bit_length()))


def folded(odd: list[bytes]) -> np.ndarray:
    """Parities of all rows (rows, words) over the fewest buckets that one has."""
    least = min(map(len, odd), default=FEWEST // 8)
    out = np.empty((len(odd), least), np.uint8)
    for i, o in enumerate(odd):
        out[i] = np.frombuffer(o, np.uint8) if len(o) == least else np.bitwise_xor.reduce(np.frombuffer(o, np.uint8).reshape(-1, least), axis=0)
    return out.view("<u8")


PRINTS = "oid long, th long, digest binary, fp long, n int, odd binary"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            fps, sizes, digests, odds = [], [], [], []
            for t in batch.column("text").cast(pa.binary()):
                hashes = shingle_hashes(t.as_py())
                one = np.unique(hashes)
                fps.append(vote(hashes))
                sizes.append(len(one))
                digests.append(hashlib.md5(one.tobytes()).digest())
                odds.append(parities(one))
            yield pa.RecordBatch.from_arrays(
                [batch.column("oid"), batch.column("th"), pa.array(digests, pa.binary()), pa.array(np.array(fps, "<u8").view("<i8"), pa.int64()), pa.array(sizes, pa.int32()), pa.array(odds, pa.binary())],
                names=["oid", "th", "digest", "fp", "n", "odd"],
            )
        give_back()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each node, once in a task."""
    seen: set[int] = set()
    for whole in batches:
        for batch in slices(whole, "text"):
            nodes, sets = [], []
            for node, t in zip(batch.column("node").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(np.unique(shingle_hashes(t.as_py())).view("<i8"))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["node", "hashes"])
        give_back()


def _span(tree: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of pairs (a, b) that join trees, earlier ones first; tree is flat before and after."""
    at, out = np.arange(len(a)), []
    while True:
        x, y = tree[a[at]], tree[b[at]]
        new = x != y
        if not new.any():
            return np.concatenate([*out, np.empty(0, np.int64)]).astype(np.int64)
        at, x, y = at[new], x[new], y[new]
        # Each root hooks on to one lesser root, so no cycle is made.
        root, first = np.unique(np.maximum(x, y), return_index=True)
        tree[root] = np.minimum(x, y)[first]
        out.append(at[first])
        while (tree[tree] != tree).any():
            tree[:] = tree[tree]


def _apart(odd: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """In how many parities rows r and c differ."""
    out = np.empty(len(r), np.int32)
    step = max(1, (1 << 20) // max(odd.shape[1], 1))
    for i in range(0, len(r), step):
        out[i : i + step] = np.bitwise_count(odd[r[i : i + step]] ^ odd[c[i : i + step]]).sum(1, dtype=np.int32)
    return out


def candidates(side: np.ndarray, fp: np.ndarray, n: np.ndarray, odd: np.ndarray, node: np.ndarray, root: np.ndarray, radius: int, spanning: bool) -> np.ndarray:
    """Pairs of nodes (m, 2) of different roots that may be similar; if spanning, forests of them."""
    by = np.argsort(n, kind="stable")
    side, fp, n, odd, node, root = side[by], fp[by], n[by], odd[by], node[by], root[by]
    ones = np.bitwise_count(fp).astype(np.int16)
    one, m = bool((side == 2).any()), 64 * odd.shape[1]
    left, right = (np.arange(len(fp)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    likely, tree, out = np.arange(len(fp)), np.arange(len(fp)), [np.empty((0, 2), np.int64)]
    for i in range(0, len(left), LEFT):
        a = left[i : i + LEFT]
        lo, hi = np.searchsorted(n[right], [-(-4 * int(n[a[0]]) // 5), 5 * int(n[a[-1]]) // 4 + 1])
        for j in range(max(lo, i) if one else lo, hi, RIGHT):
            b = right[j : min(j + RIGHT, hi)]
            if int(ones[a].min()) - int(ones[b].max()) > radius or int(ones[b].min()) - int(ones[a].max()) > radius:
                continue
            r, c = np.nonzero(np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= radius)
            r, c = a[r], b[c]
            fit = (root[r] != root[c]) & (5 * np.minimum(n[r], n[c]) >= 4 * np.maximum(n[r], n[c]))
            if one:
                fit &= r < c
            r, c = r[fit], c[fit]
            apart = _apart(odd, r, c)
            fit = 9 * apart.astype(np.int64) <= n[r] + n[c]
            r, c, apart = r[fit], c[fit], apart[fit]
            if spanning:
                # What the parities say of the number of shingles that are apart, collisions reckoned in.
                guess = -m / 2 * np.log1p(-2 * np.minimum(apart, m * 0.49) / m) / (n[r] + n[c])
                near = np.argsort(guess, kind="stable")
                r, c, sure = r[near], c[near], guess[near] * 9 <= 1
                at = np.union1d(np.flatnonzero(sure)[_span(likely, r[sure], c[sure])], _span(tree, r, c))
                r, c = r[at], c[at]
            out.append(np.stack([node[r], node[c]], 1))
    return np.concatenate(out)


def _cell_of(radius: int, spanning: bool):
    def cell(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()
        found = candidates(get("side"), get("fp").view("<u8"), get("n").astype(np.int64), folded(table.column("odd").to_pylist()), get("node"), get("root"), radius, spanning)
        out = pa.table({"a": found[:, 0].copy(), "b": found[:, 1].copy()})
        give_back()
        return out

    return cell


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of nodes whose sets are similar."""
    both = pairs
    for c in ("a", "b"):
        both = both.join(sets.select(F.col("node").alias(c), F.col("hashes").alias("x" + c)), c)
    common = F.size(F.array_intersect("xa", "xb"))
    similar = 5 * common >= 4 * (F.size("xa") + F.size("xb") - common)
    return materialize(both.filter(similar).select("a", "b"), "similar-links")


def similar_nodes(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prints, nodes, stars): oid (the doc_id, the least long for null), th (a hash of the text) and digest
    (of the set) of every row; the distinct sets, with their least row (one) and number of rows (copies);
    and the node and root of those that are linked, but for roots.
    """
    least = F.lit(-(1 << 63)).cast("long")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("oid"), text_or_empty("text").alias("text")).withColumn("th", F.xxhash64("text"))
    prints = stored(docs.mapInArrow(_prints, PRINTS))
    total = prints.count()
    distinct = prints.groupBy("digest").agg(F.min(F.struct("oid", "th")).alias("one"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.count("*").alias("copies"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "similar-nodes", few(total))
    size_class = F.floor(F.log("n") / F.log(F.lit(STEP))).cast("int").alias("p")

    def compared(rows: DataFrame, spanning: bool) -> DataFrame:
        cells = dealt_cells(rows, 1, "node", lambda p: min(BLOCK_MOST, BLOCK_BYTES // (buckets(int(STEP ** (p + 1))) // 8 + 64))).groupBy("p", "i", "q", "j")
        return materialize(cells.applyInArrow(_cell_of(radius, spanning), "a long, b long"), "similar-pairs")

    first = compared(nodes.filter("n > 0").select("node", "fp", "n", "odd", F.col("node").alias("root"), size_class), True)
    found = first.count()
    met = materialize(first.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node"), "similar-met", few(2 * found))
    wanted = met.select("node", F.col("one.oid").alias("oid"), F.col("one.th").alias("th"), "copies")
    texts = hot_join(docs.select("oid", "th", "text"), wanted, ["oid", "th"], "copies", total)
    # A document whose rows repeat gives its set in each task that has some.
    sets = texts.select("node", "text").mapInArrow(_sets, "node long, hashes array<long>").groupBy("node").agg(F.first("hashes").alias("hashes"))
    sets = materialize(sets, "similar-sets")
    links = confirmed(first.distinct(), sets)
    stars = components(links)
    rooted = met.join(stars, "node", "left").select("node", "fp", "n", "odd", F.coalesce("root", "node").alias("root"), size_class)
    second = compared(rooted, False)
    if not second.isEmpty():
        more = confirmed(second.distinct(), sets)
        if not more.isEmpty():
            stars = components(links.unionByName(more))
    return prints, nodes, stars


def rooted_nodes(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """nodes with root, the node that stands for their component."""
    return nodes.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))


def representatives(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(kept, repeated): the key (oid, th) of each component's least row; those keys that several rows have, with their number."""
    prints, nodes, stars = similar_nodes(docs, radius)
    least = rooted_nodes(nodes.select("node", "one"), stars).groupBy("root").agg(F.min("one").alias("one"))
    kept = materialize(least.select("one.oid", "one.th"), "similar-kept", few(nodes.count()))
    rows = prints.groupBy("oid", "th").agg(F.count("*").alias("copies")).filter("copies > 1")
    return kept, materialize(rows.join(kept, ["oid", "th"], "left_semi"), "similar-repeated", 8)


def near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id and component_id, the least doc_id among similar texts, of every row."""
    prints, nodes, stars = similar_nodes(docs, radius)
    rooted = rooted_nodes(nodes.select("node", "digest", "one", "copies"), stars)
    least = rooted.groupBy("root").agg(F.min("one.oid").alias("component_id"), F.count("*").alias("n"))
    named = hot_join(rooted, materialize(least, "similar-least"), ["root"], "n", nodes.count()).select("digest", "copies", "component_id")
    out = hot_join(prints.select("oid", "digest"), materialize(named, "similar-named"), ["digest"], "copies", prints.count())
    back = lambda c: F.when(F.col(c) > -(1 << 63), F.col(c))
    return out.select(back("oid").alias("doc_id"), back("component_id").alias("component_id"))
