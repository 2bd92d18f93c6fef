"""Line dedup by overlapping three-line windows.

Every run of WINDOW consecutive lines of a document is a window. Windows that occur more than
once anywhere are found by two 64-bit hashes; all occurrences but the first (the least doc_id,
then the least text digest, then the least line) are later ones, and a line goes if any later
occurrence covers it. What windows are compared is the input, not what is left.

Only hashes and positions are shuffled for the search. Hot windows are pre-aggregated and
joined by broadcast. The places of later occurrences are merged into runs of covered lines
before a document's are gathered, so a document gets a few numbers however often it repeats.

Defined results: lines end at line feeds; windows of blank lines count as any others; a
document of fewer than WINDOW lines has no window and stays whole, as a null text does; a null
doc_id comes before all; of rows that repeat both doc_id and text one is first and the others
are later occurrences throughout, which one of them if other columns differ being open; rows
that repeat a doc_id with different texts are told apart; an empty table gives an empty result;
other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, few, hot_join, materialize, stored

WINDOW = 3
KEY = ["_id", "_digest"]


def keyed(docs: DataFrame) -> list:
    """Columns _id and _digest, which tell documents apart and order them; never null where text isn't."""
    digest = F.conv(F.substring(F.md5(F.col("text").cast("string")), 1, 15), 16, 10).cast("long")
    least = F.lit(-(1 << 63)).cast("long")
    return [F.coalesce(F.col("doc_id").cast("long"), least).alias("_id"), F.when(F.col("doc_id").isNull(), digest - (1 << 60)).otherwise(digest).alias("_digest")]


def windows(docs: DataFrame) -> DataFrame:
    """_id, _digest, pos, and the two hashes h, g of every window."""
    lines = docs.select(*keyed(docs), F.split(F.col("text").cast("string"), "\n", -1).alias("line")).filter(F.size("line") >= WINDOW)
    hashed = lines.select(*KEY, F.transform("line", lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x, F.lit(7)).cast("long").alias("g"))).alias("line"))
    each = hashed.select(
        *KEY, F.posexplode(F.transform(F.slice("line", F.lit(1), F.size("line") - (WINDOW - 1)), lambda x, i: F.array(*[F.get("line", i + j) for j in range(WINDOW)]))).alias("pos", "w")
    )
    part = [F.col("w")[j] for j in range(WINDOW)]
    return each.select(*KEY, "pos", F.xxhash64(*[p["h"] for p in part]).alias("h"), F.xxhash64(*[x for p in reversed(part) for x in (p["g"], p["h"])]).alias("g"))


def later(found: DataFrame) -> DataFrame:
    """_id, _digest, pos of every window that is not the first of its kind, rows that repeat once."""
    total = found.count()
    first = F.min(F.struct(*KEY, "pos")).alias("first")
    twice = found.groupBy("h", "g").agg(F.count("*").alias("n"), first).filter("n > 1")
    twice = materialize(twice.select("h", "g", "n", F.col("first._id").alias("d1"), F.col("first._digest").alias("d2"), F.col("first.pos").alias("d3")), "line-repeats", few(total))
    joined = hot_join(found, twice, ["h", "g"], "n", total)
    return joined.filter("NOT (_id = d1 AND _digest = d2 AND pos = d3)").select(*KEY, "pos").distinct()


def gone_lines(places: DataFrame) -> DataFrame:
    """_id, _digest, gone: the numbers of the lines that windows at places cover, gathered as runs."""
    by = Window.partitionBy(*KEY).orderBy("pos")
    apart = lambda near: near.isNull() | (F.abs(near - F.col("pos")) > WINDOW)
    ends = places.withColumn("first", apart(F.lag("pos").over(by))).withColumn("last", apart(F.lead("pos").over(by))).filter("first OR last")
    gathered = ends.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "first", "last"))).alias("ends"))
    runs = F.zip_with(F.filter("ends", lambda e: e["first"]), F.filter("ends", lambda e: e["last"]), lambda a, b: F.sequence(a["pos"], b["pos"] + (WINDOW - 1)))
    return gathered.select(*KEY, F.flatten(runs).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text less the lines that go (in column text), _n_lines and _n_gone."""
    names = docs.columns
    found = stored(windows(docs))
    side = gone_lines(later(found)).withColumn("copies", F.lit(1).cast("long"))
    copies = found.filter("pos = 0").groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1")
    repeated = not copies.isEmpty()
    if repeated:
        copies = materialize(copies, "line-copies")
        side = side.drop("copies").join(copies, KEY, "full").select(*KEY, "gone", F.coalesce("n", F.lit(1)).alias("copies"))
    held = docs.select(F.struct(*[c for c in names if c != "text"]).alias("_row"), F.col("text").cast("string").alias("text"), *keyed(docs))
    if repeated and (total := copies.agg(F.sum("n")).first()[0]):
        # Rows that repeat may be a large part of the table: their keys are joined as hot ones are.
        joined = hot_join(held, materialize(side, "line-side"), KEY, "copies", total, "left")
    else:
        joined = held.join(side.hint("shuffle_hash"), KEY, "left")
    joined = joined.withColumn("line", F.split("text", "\n", -1))
    lines = F.col("line")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("line", i)), "\n")
    done = lambda rows, text, gone: rows.select("_row", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).alias("_n_lines"), gone.alias("_n_gone"))
    kept, gone = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept), F.coalesce(F.array_size("gone"), F.lit(0))
    if not repeated:
        out = done(joined, kept, gone)
    else:
        # Of the rows of one key the first of the least task stays what it is; number them a task at a time.
        again = materialize(joined.filter("copies > 1").withColumn("task", F.spark_partition_id()), "line-again")
        least = again.groupBy(*KEY).agg(F.min("task").alias("least"), F.count("*").alias("copies"))
        nth = F.row_number().over(Window.partitionBy(*KEY, "task").orderBy("task"))
        again = hot_join(again.drop("copies").withColumn("nth", nth), materialize(least, "line-least", 8), KEY, "copies", total)
        first = (F.col("nth") == 1) & (F.col("task") == F.col("least"))
        out = done(joined.filter("copies IS NULL OR copies = 1"), kept, gone).unionByName(done(again, F.when(first, kept).otherwise(""), F.when(first, gone).otherwise(F.size(lines))))
    return out.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in names], "_n_lines", "_n_gone")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars of what is left and its MD5, for every document."""
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_gone").cast("long").alias("n_removed"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"),
    )


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the lines that it keeps and n_chars of them.

    No row goes, null and empty texts stay as they are, rows that repeat are each returned (all
    but the first with an empty text if they have a window), an empty table gives an empty one.
    """
    out = dedup_lines(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS digest FROM documents),
l AS (SELECT rid, doc_id, digest, string_split(text, chr(10)) AS line FROM d WHERE text IS NOT NULL),
w AS (
  SELECT rid, doc_id, digest, i - 1 AS pos, line[i] AS a, line[i + 1] AS b, line[i + 2] AS c
  FROM l, unnest(range(1, len(line) - 1)) AS r(i) WHERE len(line) >= 3),
n AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS FIRST, digest, rid, pos) AS nth FROM w),
g AS (SELECT DISTINCT rid, pos + o AS line_no FROM n, (VALUES (0), (1), (2)) AS t(o) WHERE nth > 1),
e AS (SELECT rid, len(line) AS n_lines, unnest(line) AS x, generate_subscripts(line, 1) - 1 AS line_no FROM l),
k AS (
  SELECT e.rid, any_value(n_lines) AS n_lines, count(g.line_no) AS n_removed,
         coalesce(string_agg(x, chr(10) ORDER BY e.line_no) FILTER (WHERE g.line_no IS NULL), '') AS kept
  FROM e LEFT JOIN g ON e.rid = g.rid AND e.line_no = g.line_no GROUP BY e.rid)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(length(kept), 0)::BIGINT AS n_chars, md5(coalesce(kept, '')) AS kept_md5
FROM d LEFT JOIN k ON d.rid = k.rid
"""
