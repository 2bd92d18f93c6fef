"""Removal of repeated byte strings of LENGTH bytes by merged Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes covers it that starts anywhere else too. What follows
finds all such strings, exactly, without sorting the corpus:

1. Anchors. The least-hashed GRAM-byte string in each LENGTH-byte window is the window's anchor
   (winnowing), so equal windows have the same anchor at the same place, and windows of the
   same anchor occurrence are one fragment. An anchor that occurs once ends the search for its
   windows. Equal fragments are gathered into one, with all windows repeated; only where
   fragments with one anchor differ, each distinct one goes on.
2. Phrases. A fragment's windows, BLOCK at a time counted from the anchor, share a core of
   LENGTH - BLOCK + 1 bytes. Blocks whose core occurs once are done. In the others the core
   becomes a single symbol of a string: up to BLOCK - 1 bytes, the core, up to BLOCK - 1 bytes.
   A window is BLOCK symbols of it. A core that too many strings share is drawn out, a byte
   of its neighbours at a time, into longer cores with fewer windows each, until few share one.
3. Transforms. The strings of a bucket of cores are dealt to shards; each shard gets its
   Burrows-Wheeler transform, and the transforms are merged by iterative interleave refinement
   to the depth of a window. The blocks of two rotations or more that are left, with their
   common prefixes, are the windows that repeat.

Bytes are removed in the end, all at once.

Defined results: matches never cross documents; strings are judged on the input; a null text
counts as empty; texts under LENGTH bytes stay whole; rows that repeat, under one doc_id or
not, are documents of their own, whose texts repeat each other; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import Shard, merge
from .common import documents, few, give_back, hot_join, materialize, slices, stored

LENGTH, GRAM, BLOCK, SHARDS = 400, 32, 32, 4
#: Strings of one core before it is drawn out, and strings in a bucket.
CROWD, BUCKET = 8192, 4096
#: Bits of an anchor's hash above its place when the least is sought; a text may have 2**(64 - BITS) bytes.
BITS = 32
#: Bytes of a text that are looked at together.
PIECE = 1 << 20
#: Bytes of texts whose equal fragments are gathered before they are shuffled.
TOGETHER = 8 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of data[i:i + gram] for every i, by polynomials mod 2**64, mixed."""
    m = np.uint64(MULTIPLIER)
    h, power, step = np.zeros(len(data) - gram + 1, np.uint64), data.astype(np.uint64) + np.uint64(1), 1
    # Doubling: the hash of 2 * step bytes from those of step bytes; gram is a power of two.
    while step < gram:
        shift = np.uint64(pow(int(m), step, 1 << 64))
        power = power[: len(power) - step] * shift + power[step:]
        step *= 2
    h = power[: len(h)].copy()
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def least_in_windows(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i + w]) for every i, from running minima in blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """(place, hash, first, last): each anchor occurrence and the starts of the windows that have it."""
    place, key, first, last = [], [], [], []
    n = len(text) - length + 1
    for lo in range(0, n, PIECE):
        hi = min(lo + PIECE, n)
        h = gram_hashes(np.frombuffer(text, np.uint8, hi - lo + length - 1, lo), gram)
        near = (h >> np.uint64(64 - BITS) << np.uint64(64 - BITS)) | np.arange(len(h), dtype=np.uint64)
        at = (least_in_windows(near, length - gram + 1) & np.uint64((1 << (64 - BITS)) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        place.append(at[new] + lo)
        key.append(h[at[new]])
        first.append(new + lo)
        last.append(np.concatenate([new[1:], [len(at)]]) - 1 + lo)
    if not place:
        return (np.empty(0, np.int64),) * 4
    place, key, first, last = (np.concatenate(x) for x in (place, key, first, last))
    # An anchor on both sides of a piece's end is one.
    same = np.concatenate([[False], place[1:] == place[:-1]])
    last[np.flatnonzero(same) - 1] = last[same]
    return place[~same], key[~same].view(np.int64), first[~same], last[~same]


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of starts, neighbours put together."""
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


ANCHOR = "done boolean, key long, c1 long, c2 long, d long, g long, place int, first int, last int, n int"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in (part for whole in batches for part in slices(whole, "text", TOGETHER)):
        held: dict[tuple[int, bytes], list] = {}
        done: dict[tuple[int, int], list] = {}
        docs = zip(batch.column("d").to_pylist(), batch.column("g").to_pylist(), batch.column("text"), strict=True)
        for d, g, value in docs:
            text = value.as_py() or b""
            for place, key, first, last in zip(*(x.tolist() for x in anchors(text)), strict=True):
                c = xxh3_128_digest(text[first : last + LENGTH])
                row = held.setdefault((key, c, place - first), [d, g, place, first, last, 0])
                row[5] += 1
                if row[5] > 1:  # equal fragments of one batch need no other to be repeats
                    done.setdefault((d, g), []).append((first, last))
                    if row[5] == 2:
                        done.setdefault((row[0], row[1]), []).append((row[3], row[4]))
        runs = [(d, g, lo, hi) for (d, g), r in done.items() for lo, hi in _joined(r)]
        keys = np.array([k[0] for k in held] + [0] * len(runs), np.int64)
        c = np.frombuffer(b"".join(k[1] for k in held) + bytes(16 * len(runs)), "<i8").reshape(-1, 2)
        rows = np.array([*held.values()], np.int64).reshape(-1, 6)
        r = np.array(runs, np.int64).reshape(-1, 4)
        cat = lambda i, j: np.concatenate([rows[:, i], r[:, j]])
        small = lambda x: pa.array(x.astype(np.int32))
        zero = np.zeros(len(r), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(keys)) >= len(rows)), pa.array(keys), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), pa.array(cat(0, 0)), pa.array(cat(1, 1)),
                small(np.concatenate([rows[:, 2], zero])), small(cat(3, 2)), small(cat(4, 3)), small(np.concatenate([rows[:, 5], zero])),
            ],
            names=["done", "key", "c1", "c2", "d", "g", "place", "first", "last", "n"],
        )
        del held, done, keys, c, rows, r
        give_back()


PHRASE = "k1 long, k2 long, d long, g long, start int, head binary, tail binary"


def _phrase_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    core = LENGTH - BLOCK + 1
    for batch in (part for whole in batches for part in slices(whole, "text", TOGETHER // 4)):
        keys, rows, heads, tails = [], [], [], []
        for d, g, value, found in zip(batch.column("d").to_pylist(), batch.column("g").to_pylist(), batch.column("text"), batch.column("found").to_pylist(), strict=True):
            text = value.as_py()
            for f in found:
                place, first, last = f["place"], f["first"], f["last"]
                for b in range((place - last) // BLOCK, (place - first) // BLOCK + 1):
                    at = place - b * BLOCK  # where the core begins: the last start of the block
                    lo, hi = max(first, at - BLOCK + 1), min(last, at)
                    keys.append(xxh3_128_digest(text[at : at + core]))
                    rows.append((d, g, lo))
                    heads.append(text[lo:at])
                    tails.append(text[at + core : hi + LENGTH])
        k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        r = np.array(rows, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(r[:, 0].copy()), pa.array(r[:, 1].copy()), pa.array(r[:, 2].astype(np.int32)), pa.array(heads, pa.binary()), pa.array(tails, pa.binary())],
            names=["k1", "k2", "d", "g", "start", "head", "tail"],
        )
        del keys, rows, heads, tails, k, r
        give_back()


def repeated_windows(cores: np.ndarray, heads: list[bytes], tails: list[bytes], depth: np.ndarray, shard: np.ndarray) -> list[tuple[int, int]]:
    """(string, place) of windows that occur twice or more in the strings head + core + tail.

    A window of string i is depth[i] symbols; strings with the same core have the same depth.
    """
    out: list[tuple[int, int]] = []
    for deep in np.unique(depth):
        mine = np.flatnonzero(depth == deep)
        names = np.unique(cores[mine], return_inverse=True)[1] + 257
        parts, where = [], []
        for s in np.unique(shard[mine]):
            own = np.flatnonzero(shard[mine] == s)
            # All strings after each other as bytes, the core and the terminator as one byte each, then as symbols.
            ahead, behind = (np.array([len(x[mine[i]]) for i in own]) for x in (heads, tails))
            sizes = ahead + behind + 2
            starts = np.concatenate([[0], np.cumsum(sizes)])
            symbols = np.frombuffer(b"".join(b for i in own for b in (heads[mine[i]], b"\0", tails[mine[i]], b"\0")), np.uint8).astype(np.int32) + 1
            symbols[starts[:-1] + ahead], symbols[starts[1:] - 1] = names[own], 0
            parts.append(Shard(symbols, starts))
            row = np.repeat(np.arange(len(own)), sizes)
            where.append((mine[own][row], np.arange(starts[-1]) - starts[row], np.repeat(sizes, sizes)))
        who, _, common = merge(parts, int(deep))
        string, place, size = (np.empty(len(who), np.int32) for _ in range(3))
        for i, (part, w) in enumerate(zip(parts, where, strict=True)):
            at = who == i
            string[at], place[at], size[at] = w[0][part.order], w[1][part.order], w[2][part.order]
        head = np.array([len(h) for h in heads])
        whole = (place <= head[string]) & (place + deep <= size - 1)  # with the core, without the terminator
        # The repeated intervals: neighbours whose common prefix is a whole window.
        interval = np.cumsum(common < deep)
        count = np.bincount(interval[whole], minlength=1)
        again = whole.copy()
        again[whole] = count[interval[whole]] > 1
        out += zip(string[again].tolist(), place[again].tolist(), strict=True)
    return out


RUNS = "d long, g long, first int, last int"


def _bucket(table: pa.Table) -> pa.Table:
    k = np.stack([table.column("k1").to_numpy(), table.column("k2").to_numpy()], 1)
    cores = np.unique(k, axis=0, return_inverse=True)[1].ravel()
    d, g, start = (table.column(c).to_numpy() for c in ("d", "g", "start"))
    heads, tails = table.column("head").to_pylist(), table.column("tail").to_pylist()
    shard = (d.view(np.uint64) * np.uint64(MULTIPLIER) >> np.uint64(40)) % np.uint64(SHARDS)
    runs: dict[tuple[int, int], list] = {}
    for i, p in repeated_windows(cores, heads, tails, table.column("block").to_numpy(), shard):
        runs.setdefault((int(d[i]), int(g[i])), []).append((int(start[i]) + p, int(start[i]) + p))
    flat = np.array([(*k, lo, hi) for k, r in runs.items() for lo, hi in _joined(r)], np.int64).reshape(-1, 4)
    out = pa.table({"d": flat[:, 0], "g": flat[:, 1], "first": flat[:, 2].astype(np.int32), "last": flat[:, 3].astype(np.int32)})
    del k, cores, heads, tails, runs, flat
    give_back()
    return out


def drawn_out(rows: DataFrame, block: int, into: int) -> DataFrame:
    """Strings of blocks of block windows as strings of blocks of into windows, with longer cores.

    Window number p of a block starts p - block + 1 bytes before the core. The windows
    (q * into, (q + 1) * into - 1) have in common the core, what the last of them has before
    it, and what the first of them has after it.
    """
    tail_of = lambda p: f"{p}"  # noqa: E731  window p ends p bytes after the core
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(block // into - 1))))
    lo, hi = f"q * {into}", f"q * {into} + {into - 1}"
    # In a head of h bytes window p begins at byte h - (block - 1 - p).
    first = f"greatest(0, length(head) - ({block - 1} - ({lo})))"
    core = f"length(head) - ({block - 1} - ({hi}))"
    rows = rows.withColumn("a", F.expr(first)).withColumn("b", F.expr(core)).withColumn("e", F.expr(f"least(length(tail), {tail_of(hi)})"))
    rows = rows.filter(f"b >= 0 AND length(tail) >= {lo}")
    inner = f"substring(head, b + 1, length(head) - b), 'x', substring(tail, 1, {lo})"
    return rows.select(
        F.expr(f"xxhash64(k1, k2, q, {inner})").alias("k1"), F.expr(f"xxhash64(k2, {inner}, q, k1)").alias("k2"), "d", "g", (F.col("start") + F.col("a")).cast("int").alias("start"),
        F.expr("substring(head, a + 1, b - a)").alias("head"), F.expr(f"substring(tail, {lo} + 1, e - {lo})").alias("tail"),
    )


def crowded(rows: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(strings whose core at least two and at most crowd have, strings of fuller cores)."""
    total = rows.count()
    counts = materialize(rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1"), "bwt-cores", few(total))
    marked = materialize(hot_join(rows, counts, ["k1", "k2"], "n", total), "bwt-strings", few(total))
    return marked.filter(F.col("n") <= crowd).drop("n"), marked.filter(F.col("n") > crowd).drop("n")


def repeats(docs: DataFrame, crowd: int | None = None) -> DataFrame:
    """d, g, first, last: runs of starts of windows that occur elsewhere too, of documents d, g, text (binary)."""
    crowd = crowd or CROWD
    held = rows = stored(docs.filter(F.length("text") >= LENGTH).mapInArrow(_anchor_rows, ANCHOR))
    done = rows.filter("done").select("d", "g", "first", "last")
    rows = rows.filter("NOT done")
    kind = ["key", "c1", "c2", "ahead"]
    rows, total = rows.withColumn("ahead", F.col("place") - F.col("first")), held.count()
    classes = materialize(rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(F.struct("d", "g", "place", "first", "last")).alias("one")), "bwt-classes", few(total))
    same = hot_join(rows.drop("n"), classes.filter("rows > 1").select(*kind, F.col("rows").alias("n")), kind, "n", total).select("d", "g", "first", "last")
    kinds = materialize(classes.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "bwt-kinds", few(total))
    differ = hot_join(classes.select("key", "one"), kinds, ["key"], "m", total).select("one.*")
    wanted = differ.groupBy("d", "g").agg(F.collect_list(F.struct("place", "first", "last")).alias("found")).hint("shuffle_hash")
    strings = materialize(docs.join(wanted, ["d", "g"]).mapInArrow(_phrase_rows, PHRASE), "bwt-phrases")
    found, block = [done, same], BLOCK
    while True:
        light, full = crowded(strings, crowd if block > 1 else 1)
        if block == 1:
            # A core of a whole window: all that share it are repeats.
            found.append(full.select("d", "g", F.col("start").alias("first"), F.col("start").alias("last")))
            break
        n = light.count()
        light = light.withColumn("block", F.lit(block)).withColumn("bucket", F.pmod(F.xxhash64("k1", "k2"), F.lit(-(-n // BUCKET) * 4 or 1)))
        if n:
            found.append(light.groupBy("bucket").applyInArrow(_bucket, RUNS))
        if full.isEmpty():
            break
        strings, block = materialize(drawn_out(full, block, block // 4 if block > 2 else 1), "bwt-drawn"), block // 4 if block > 2 else 1
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text", TOGETHER)):
        rows = []
        for value, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
            text = value.as_py() or b""
            spans = [(lo, hi + LENGTH) for lo, hi in _joined([(r["first"], r["last"]) for r in runs or []])]
            spans = [(lo, hi - 1) for lo, hi in spans]
            spans = _joined(spans)
            kept, at = hashlib.sha256(), 0
            for lo, hi in spans:
                kept.update(text[at:lo])
                at = hi + 1
            kept.update(text[at:])
            rows.append((len(text), sum(hi - lo + 1 for lo, hi in spans), len(spans), kept.hexdigest()))
        n, removed, spans, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )
        give_back()


def remove_repeats(docs: DataFrame, crowd: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("d"), F.xxhash64("text", F.col("doc_id").isNull()).alias("g"))
    runs = repeats(rows.select("d", "g", "text"), crowd)
    side = runs.groupBy("d", "g").agg(F.collect_set(F.struct("first", "last")).alias("runs")).hint("shuffle_hash")
    out = rows.join(side, ["d", "g"], "left").select("doc_id", "text", "runs")
    return out.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
