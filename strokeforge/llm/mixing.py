"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is shuffled (by the MD5 of the document id), laid out as one stream of words
and cut into blocks of equally many words; the stream repeats from its start as often as the
source may be repeated. Slot i of the mix gets the golden-ratio point frac(i * 0.618...), and
the cumulative weights map the point to a source. The r-th slot of a source takes block r of
its stream, so any stretch of the mix holds the sources in their target shares. The last
block of a source ends where its target does; a source that the points gave a slot too few
gets it after the others.

Positions in streams are running sums over ranges (see scans), ranks of slots prefix sums in two
levels (chunk totals, then offsets within a chunk), so no task ever sees a whole source, nor all
rows of one or no doc_id.

Defined results: a null or empty text has size 0 and is never taken; a null source is a
source of its own, last in order; rows that repeat a doc_id are documents of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_LEAST, WORD, documents, few, materialize, stored
from .scans import ranged, running

WEIGHTS = (3, 1, 2)
OVERSAMPLE, CAP, BLOCK = 1.5, 2.0, 1024
#: 2**32 divided by the golden ratio: i * STEP mod 2**32 is a golden-ratio sequence in integers.
STEP, SPAN = 2_654_435_769, 1 << 32
CELLS = 4096
CHUNK = 1 << 16


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, k (source; sorts by code point with null last), size, and the shuffle key, which is never null."""
    return docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source"))).alias("k"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))).alias("key"),
    )


def targets(rows: DataFrame, weights=WEIGHTS, oversample=OVERSAMPLE, cap=CAP) -> DataFrame:
    """k, source_size, target of each source of rows (k, size).

    Water filling: with the sources by rising cap / weight, the first that stays below its cap
    fixes the level; those before it are full. One row a source.
    """
    everything = Window.partitionBy()
    by_k, by_ratio = everything.orderBy("k"), everything.orderBy("ratio", "k")
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_k) - 1) % len(weights) + 1).cast("int"))
    src = (
        rows.groupBy("k").agg(F.sum("size").alias("source_size"))
        .withColumn("w", share)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("w"))
    )
    total = F.sum("source_size").over(everything) * F.lit(float(oversample))
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left_w = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level", (total - before) / left_w)
    level = F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(everything)
    return src.withColumn("target", F.least("most", F.coalesce(F.col("w") * level, F.col("most")))).select("k", "source_size", "target")


def schedule(spark: SparkSession, src: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, k, rank: which block of which source each slot of the mix takes."""
    need = F.ceil(F.col("goal") / block)
    everything = Window.partitionBy()
    src = src.select("k", F.floor(F.col("target") + 0.5).cast("long").alias("goal"))
    ends = F.sum("goal").over(everything.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    src = (
        src.withColumn("need", need).withColumn("end", ends).withColumn("all", F.sum("goal").over(everything))
        .withColumn("lo", F.floor((F.col("end") - F.col("goal")) / F.col("all") * SPAN))
        .withColumn("hi", F.floor(F.col("end") / F.col("all") * SPAN))
        .filter("goal > 0")
    )
    total = src.agg(F.max("all")).first()[0] or 0
    n = -(-total // block)
    width = SPAN // CELLS
    cells = src.filter("hi > lo").withColumn("cell", F.explode(F.sequence((F.col("lo") / width).cast("long"), ((F.col("hi") - 1) / width).cast("long"))))
    slots = spark.range(n).select(F.col("id").alias("slot"), (F.col("id") * STEP % SPAN).alias("u")).withColumn("cell", (F.col("u") / width).cast("long"))
    slots = slots.join(cells.select("cell", "k", "lo", "hi", "need"), "cell").filter("u >= lo AND u < hi").select("slot", "k", "need")
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = slots.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    firsts = counts.withColumn("first", F.sum("n").over(Window.partitionBy("k").orderBy("chunk")) - F.col("n")).drop("n")
    local = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1
    ranked = slots.join(firsts, ["k", "chunk"]).withColumn("rank", F.col("first") + local).filter("rank < need").select("slot", "k", "rank")
    had = counts.groupBy("k").agg(F.sum("n").alias("had"))
    short = (
        src.join(had, "k", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < need")
        .withColumn("rank", F.explode(F.sequence(F.col("had"), F.col("need") - 1)))
        .select((F.lit(n) + F.col("rank")).alias("slot"), "k", "rank")
    )
    return ranked.unionByName(short)


def pieces(docs: DataFrame, block: int = BLOCK, weights=WEIGHTS, oversample=OVERSAMPLE, cap=CAP):
    """(laid, mixed): every document with its place in its source's stream, and the words taken of it.

    laid: doc_id, k, size, dup, at, source_size, target. mixed: slot, k, rank, doc_id, size,
    dup, epoch, start, words: the mix itself, in the order of slot, rank, epoch, start.
    """
    spark = docs.sparkSession
    # Rows of one key and size can take each other's place, so where ranges part them doesn't matter.
    order = ["k", "key", "size", "row"]
    rows = ranged(stored(sized(docs)).withColumn("row", F.monotonically_increasing_id()), order)
    src = materialize(targets(rows, weights, oversample, cap), "mix-sources", 8)
    dup = running(rows, ["k", "key", "size"], order, {"dup": ("sum", F.lit(1).cast("long"))})
    upto = running(dup, ["k"], order, {"upto": ("sum", F.col("size"))})
    laid = upto.join(src.hint("shuffle_hash") if src.count() > HOT_LEAST else F.broadcast(src), "k")
    laid = laid.select("doc_id", "k", "size", "dup", (F.col("upto") - F.col("size")).alias("at"), "source_size", "target")
    laid = materialize(laid, "mix-laid", few(rows.count()))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    spans = (
        laid.filter("size > 0").withColumn("goal", goal)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(-(-cap // 1)) - 1))))
        .withColumn("lo", F.col("at") + F.col("epoch") * F.col("source_size"))
        .withColumn("hi", F.least(F.col("lo") + F.col("size"), "goal")).filter("lo < hi")
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
        .withColumn("start", F.greatest(F.col("rank") * block - F.col("lo"), F.lit(0)))
        .withColumn("words", F.least(F.col("hi"), (F.col("rank") + 1) * block) - F.col("lo") - F.col("start"))
        .select("k", "rank", "doc_id", "size", "dup", "epoch", "start", "words")
    )
    return laid, schedule(spark, src, block).join(spans, ["k", "rank"])


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    laid, mixed = pieces(docs, **how)
    taken = mixed.groupBy("doc_id", "k", "size", "dup").agg(F.sum("words").alias("taken"))
    match = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "k", "size", "dup")]
    return laid.alias("a").join(taken.alias("b"), match, "left").select(
        "a.doc_id", "a.size", "a.source_size", F.round("a.target", 6).alias("target"), F.coalesce("b.taken", F.lit(0)).cast("long").alias("taken")
    )


def mix_rows(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, whole rows: each as often as a block that holds its first word is taken."""
    _, mixed = pieces(docs, **how)
    copies = mixed.filter("start = 0").groupBy("doc_id", "k", "size", "dup").agg(F.count("*").alias("copies"))
    names = docs.columns
    same = Window.partitionBy("doc_id", "k", "size").orderBy("_tie")
    held = docs.select(F.struct("*").alias("_row"), F.xxhash64("text").alias("_tie"), "doc_id", "text", "source")
    held = held.select("_row", "_tie", "doc_id", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source"))).alias("k"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    held = held.withColumn("dup", F.row_number().over(same))
    match = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "k", "size", "dup")]
    out = held.alias("a").join(copies.alias("b"), match).select("a._row", F.explode(F.sequence(F.lit(1), F.col("b.copies").cast("int"))))
    return out.select(*[F.col("_row")[c].alias(c) for c in names])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all documents as whole rows; some repeat, some of a source that weighs little are left.

    Null texts and texts without words are never taken; rows that repeat are documents of their
    own; a null source is a source; an empty table gives an empty one.
    """
    return mix_rows(docs)


#: Independent of blocks and slots: what each source's stream, cut at its target, holds of each document.
SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, md5('mix:' || doc_id) AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT k, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY k),
r AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / w AS ratio FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s) * 1.5::DOUBLE
    - coalesce(sum(most) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT k, source_size, least(most, coalesce(w * (SELECT max(level) FROM l WHERE level < ratio), most)) AS target FROM l),
a AS (
  SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS goal,
         (sum(size) OVER (PARTITION BY d.k ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos
  FROM d JOIN t ON d.k = t.k)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (greatest(0, least(pos + size, goal) - pos) + greatest(0, least(pos + size + source_size, goal) - pos - source_size))::BIGINT AS taken
FROM a
"""
