"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

The sketch of a text is the K least of the distinct 64-bit hashes of its five-word shingles
(lower case, words split at ASCII white space; a shorter text is one shingle, a text without
words none). Sketches merge: the sketch of several parts is the K least of theirs together,
but for shingles across the seams. Of two sketches, the K least hashes of both together are a
uniform sample of the union of their shingles; how many of the sample both, or the first, have
estimates resemblance and containment. Under K hashes a sketch is the whole set and the
estimates are exact.

The next document by id comes by a window over buckets of consecutive ids: their bounds are
quantiles, MOST_BUCKETS at most, and the first row of each bucket is also sent to the one
before. Text is shuffled once. Where ids repeat, rows that are equal are gathered into one with
their number, keys of id and text hash are put in order without their texts, by ranges, and each
key then gets the text of the next: no task holds all rows of one id.

Defined results: a null text counts as empty; two empty sketches are alike (1), an empty and
another are not (0); rows that repeat a doc_id follow one another in an order by their texts'
hashes; a null doc_id comes before all; a table's only row is its own next; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, text_or_empty

K, SHINGLE = 128, 5
SPACES = " \t\n\x0b\f\r"
BUCKET_ROWS, MOST_BUCKETS = 128, 8192
FAN_IN = 64


def word_hashes(text: Column) -> Column:
    """Hashes of the words of text in order; empty where it has none."""
    trimmed = F.btrim(F.lower(text), F.lit(SPACES))
    words = F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
    return F.when(F.length(trimmed) > 0, words).otherwise(F.array().cast("array<bigint>"))


def sketch(words: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The bottom-k sketch from a column of word hashes."""
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - (shingle - 1), F.least(F.size(words), F.lit(1))))
    hashes = F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, shingle)]))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    words = f"_{name}_words"
    return df.withColumn(words, word_hashes(F.col(text))).withColumn(name, sketch(F.col(words), k)).drop(words)


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of either that both have."""
    sample = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), sample))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(sample))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of a that b has; 1 if a has none."""
    mine = F.array_intersect(a, merged(a, b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(mine, b)), F.size(mine)), F.lit(0.0)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact under k, else from the k-th least hash."""
    at = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / at)


def text_form(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merge_parts(df: DataFrame, group: str, name: str, k: int = K) -> DataFrame:
    """group and the merged sketch of its rows' sketches, FAN_IN at a time, so that no task gathers a large group."""
    rows, most = df.select(group, name), df.groupBy(group).count().agg(F.max("count")).first()[0] or 1
    rows, parts = rows.withColumn("_p", F.xxhash64(name)), 1
    while parts * FAN_IN < most:
        parts *= FAN_IN
    while True:
        gathered = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set(name)))), 1, k)
        rows = rows.groupBy(group, F.pmod("_p", F.lit(parts)).alias("_p")).agg(gathered.alias(name))
        if parts == 1:
            return rows.drop("_p")
        parts //= FAN_IN


def _buckets(docs: DataFrame) -> list[int]:
    """The first ids of buckets of consecutive ids, about BUCKET_ROWS rows each but MOST_BUCKETS at most."""
    n, least = docs.agg(F.count("*"), F.min("oid")).first()
    parts = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    bounds = docs.agg(F.percentile_approx("oid", [i / parts for i in range(parts)] or [0.0], 4 * parts)).first()[0] or []
    return sorted({least if least is not None else 0, *bounds})


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """doc_id, text, next (the next document's text), and guest for rows that only precede nothing."""
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("oid", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    bounds = _buckets(rows.select("oid"))
    # Two steps find an id's bucket: among each WIDE-th bound, then among the bounds from there.
    wide = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[::wide]])
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in bounds[i : i + wide]]) for i in range(0, len(bounds), wide)])
    below = lambda a: F.size(F.filter(a, lambda b: b <= F.col("oid")))
    rows = rows.withColumn("c", F.greatest(below(coarse) - 1, F.lit(0))).withColumn("f", F.get(fine, "c"))
    rows = rows.withColumn("at", F.greatest(below(F.col("f")) - 1, F.lit(0))).withColumn("own", F.col("c") * wide + F.col("at"))
    is_first = F.get("f", F.col("at")) == F.col("oid")
    stay = F.struct(F.col("own").alias("b"), F.lit(0).alias("guest"))
    before = F.struct(F.when(F.col("own") == 0, len(bounds) - 1).otherwise(F.col("own") - 1).alias("b"), F.when(F.col("own") == 0, 2).otherwise(1).alias("guest"))
    rows = rows.withColumn("to", F.explode(F.when(is_first, F.array(stay, before)).otherwise(F.array(stay)))).select("doc_id", "text", "oid", "to.b", "to.guest")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("last", F.when(F.col("guest") == 2, 1).otherwise(0))
    w = Window.partitionBy("b").orderBy("last", "oid", "guest", "tie")
    return rows.withColumn("next", F.coalesce(F.lead("text").over(w), F.lit(""))), w


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint (sketch), n_chars, n_shingles of every row."""
    rows = with_sketch(docs.select("doc_id", text_or_empty("text").alias("text")), "text", "fingerprint", k)
    return rows.select("doc_id", "fingerprint", F.length("text").cast("long").alias("n_chars"), distinct_shingles(F.col("fingerprint"), k).alias("n_shingles"))


def next_of_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, next, times for a table whose ids repeat: so many rows have this text and this next document's."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("oid"), text_or_empty("text").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    one = materialize(rows.groupBy("oid", "tie").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "next-texts")
    parted = materialize(one.select("oid", "tie").repartitionByRange("oid", "tie").withColumn("part", F.spark_partition_id()), "next-keys")
    key, by_part = F.struct("oid", "tie"), Window.orderBy("part")
    firsts = parted.groupBy("part").agg(F.min(key).alias("first"))  # a row a part
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(by_part), F.min("first").over(Window.partitionBy())).alias("after"))
    inner = F.lead(key).over(Window.partitionBy("part").orderBy("oid", "tie"))
    following = parted.withColumn("to", inner).join(F.broadcast(firsts), "part").select("oid", "tie", F.coalesce("to", "after").alias("to"))
    following = following.select("oid", "tie", F.col("to.oid").alias("next_oid"), F.col("to.tie").alias("next_tie"))
    texts = one.select(F.col("oid").alias("next_oid"), F.col("tie").alias("next_tie"), F.col("text").alias("next"))
    both = one.join(following, ["oid", "tie"]).join(texts, ["next_oid", "next_tie"])
    last, others = F.struct(F.col("next"), F.lit(1).cast("long").alias("times")), F.struct(F.col("text").alias("next"), (F.col("copies") - 1).alias("times"))
    rows = both.withColumn("x", F.explode(F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last))))
    return rows.select(F.when(F.col("oid") > -(1 << 63), F.col("oid")).alias("doc_id"), "text", "x.next", "x.times")


def compare_with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """The digest columns of op1 for every row."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("oid"))
    repeats = not ids.groupBy("oid").count().filter("count > 1").isEmpty()
    if repeats:
        rows = with_sketch(next_of_repeats(docs), "next", "following", k)
    else:
        rows, w = with_next(docs)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next", F.lit(1), half))
    ).drop("next")
    rows = with_sketch(rows, "text", "mine", k).drop("text")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_sketch(rows, "edited", "other", k).drop("edited")
    if not repeats:
        rows = rows.withColumn("following", F.lead("mine").over(w)).filter("guest = 0").withColumn("times", F.lit(1).cast("long"))
    out = rows.select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("mine")).alias("fingerprint"), text_form(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("mine"), F.col("other"), k).alias("near_edited"), resemblance(F.col("mine"), F.col("following"), k).alias("near_next"),
        containment(F.col("mine"), F.col("other"), k).alias("contained_in_edited"), distinct_shingles(F.col("mine"), k).alias("n_shingles"), "times",
    )
    if repeats:
        out = out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_")
    return out.drop("times")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))
