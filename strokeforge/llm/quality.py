"""Quality rules by host: failures of rules per source, shrunk by an empirical beta prior, joined back to documents.

Every document is counted by built-in functions on its own row, whole. Each rule's failures are
summed by host (the column source); a beta prior is fitted to all hosts' rates by moments (H,
sums of n, n squared, k and k squared over n: one row), and a host fails a rule if the mean of
its posterior is beyond RATE. A document is kept if it passes the base rule itself and its host
fails no rule. A host of few documents stands near the mean of all; one of many near its own rate.

Words found in repeated windows: hashes of eight words that occur twice in a text are found by
sorting the text's own hashes (64 bits; two different windows of one text that share a hash would
count as equal); texts without a repeated hash, most of them, are not sorted.

Defined results: a null text has no words and fails the base rule; an empty one likewise; a null
source is a host of its own, apart from an empty one; rows are judged one by one, so rows that
repeat and null doc_ids each get a verdict and count in their host; an empty table gives an
empty result; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, few, hot_join, materialize

WINDOW = 8
#: The base rule: too few words, or too many of them in repeated windows (per cent).
WORDS_LEAST, REPEATED_MOST = 20, 30
#: Rules whose failures are summed by host, over the counts of a document.
RULES = {
    "base": "base_failed",
    "symbols": "n_words > 0 AND 10 * n_symbols > n_words",
    "lines": "n_lines > 0 AND 10 * n_dup_lines > 3 * n_lines",
    "length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}
#: A host fails a rule beyond this mean rate of failures.
RATE = 0.5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

_WORDS = r"filter(split(text, '[\\x20\\x09-\\x0D]+', -1), x -> x <> '')"
_LINES = r"filter(split(text, '\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"
_HASHES = f"transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64({', '.join(f'element_at(words, i + {j})' for j in range(WINDOW))}))"
_TWICE = "filter(twice, (s, i) -> coalesce(s.h = get(twice, i - 1).h, false) OR coalesce(s.h = get(twice, i + 1).h, false))"


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """_row (a struct of the columns of keep), _host, COUNTS and base_failed of every document."""
    host = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("_row"), host.alias("_host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select(
        "_row", "_host", F.expr(f"transform({_WORDS}, x -> xxhash64(x))").alias("words"), F.expr(_LINES).alias("lines"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"), (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    d = d.withColumn("hashes", F.expr(f"if(size(words) < {WINDOW}, array(), {_HASHES})"))
    d = d.withColumn("twice", F.expr("if(size(array_distinct(hashes)) = size(hashes), filter(array(struct(0L AS h, 0 AS i)), x -> false), sort_array(transform(hashes, (h, i) -> struct(h, i))))"))
    d = d.withColumn("places", F.expr(f"sort_array(transform({_TWICE}, s -> s.i))"))
    covered = f"aggregate(places, struct(-{WINDOW} AS last, 0L AS n), (s, p) -> struct(p AS last, s.n + least({WINDOW}, p - s.last) AS n)).n"
    d = d.select(
        "_row", "_host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.expr(covered).alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", F.expr(f"n_words < {WORDS_LEAST} OR 100 * n_repeat_words > {REPEATED_MOST} * n_words"))


def beta_prior(hosts: int, n: float, n2: float, k: float, k2n: float) -> tuple[float, float]:
    """a and b of a beta prior by moments: from the number of hosts and their sums of n, n * n, k and k * k / n."""
    mean = k / n if n else 0.0
    spread = mean * (1 - mean)
    within = n - n2 / n - (hosts - 1) if n else 0.0
    # The share of the variance that lies between hosts; none can be told from one host or from equal rates.
    share = ((k2n - mean * k) - spread * (hosts - 1)) / (spread * within) if spread * within > 0 else 0.0
    size = 1 / min(max(share, 1e-9), 1 - 1e-9) - 1
    return mean * size, (1 - mean) * size


def host_verdicts(counts: DataFrame) -> DataFrame:
    """_host, _docs (its documents), _failed (the rules that it fails) of every host; a stored table."""
    hosts = counts.groupBy("_host").agg(F.count("*").alias("_docs"), *[F.sum(F.expr(rule).cast("long")).alias(name) for name, rule in RULES.items()])
    hosts = materialize(hosts, "quality-hosts")
    moments = [F.sum(c) for name in RULES for c in (F.col(name).cast("double"), F.col(name).cast("double") * F.col(name) / F.col("_docs"))]
    n_hosts, n, n2, *rest = hosts.agg(F.count("*"), F.sum(F.col("_docs").cast("double")), F.sum(F.col("_docs").cast("double") * F.col("_docs")), *moments).first()
    failed = []
    for i, name in enumerate(RULES):
        a, b = beta_prior(n_hosts, n or 0.0, n2 or 0.0, rest[2 * i] or 0.0, rest[2 * i + 1] or 0.0)
        failed.append(F.when(F.col(name) + a > RATE * (F.col("_docs") + a + b), F.lit(name)))
    return materialize(hosts.select("_host", "_docs", F.array_compact(F.array(*failed)).alias("_failed")), "quality-verdicts")


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (all of docs by default) of every row, and _quality: a struct of COUNTS, base_failed, host_failed (rules) and kept."""
    keep = docs.columns if keep is None else keep
    counts = materialize(counted(docs, keep), "quality-counts")
    verdicts = host_verdicts(counts)
    judged = hot_join(counts, verdicts, ["_host"], "_docs", counts.count())
    fields = F.struct(*COUNTS, "base_failed", F.col("_failed").alias("host_failed"), (~F.col("base_failed") & (F.size("_failed") == 0)).alias("kept"))
    return judged.select(*[F.col("_row")[c].alias(c) for c in keep], fields.alias("_quality"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its counts, base_failed and kept, for every document."""
    out = judge(documents(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", *[f"_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


_SUMS = ", ".join(f"sum(({rule})::INT)::DOUBLE AS k_{name}" for name, rule in RULES.items())
_MOMENTS = ", ".join(f"sum(k_{name}) AS k_{name}, sum(k_{name} * k_{name} / n) AS q_{name}" for name in RULES)
_SHARES = ", ".join(
    f"coalesce((q_{r} - k_{r} / n * k_{r} - k_{r} / n * (1 - k_{r} / n) * (hosts - 1)) / nullif(greatest(k_{r} / n * (1 - k_{r} / n) * (n - n2 / n - (hosts - 1)), 0), 0), 0) AS s_{r}, k_{r} / n AS m_{r}" for r in RULES
)
_SIZES = ", ".join(f"1 / least(greatest(s_{r}, 1e-9), 1 - 1e-9) - 1 AS z_{r}, m_{r}" for r in RULES)
_FAILS = " OR ".join(f"k_{r} + m_{r} * z_{r} > {RATE} * (n + z_{r})" for r in RULES)
SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, 'n') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, list_slice(words, i, i + {WINDOW - 1}) AS win FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS r(i)),
t AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
p AS (SELECT rid, count(DISTINCT i + o)::BIGINT AS n_repeat_words FROM t, range({WINDOW}) AS r(o) GROUP BY rid),
c AS (
  SELECT w.rid, doc_id, host, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN p ON w.rid = p.rid),
f AS (SELECT * REPLACE (coalesce(word_chars, 0) AS word_chars), n_words < {WORDS_LEAST} OR 100 * n_repeat_words > {REPEATED_MOST} * n_words AS base_failed FROM c),
h AS (SELECT host, count(*)::DOUBLE AS n, {_SUMS} FROM f GROUP BY host),
a AS (SELECT count(*) AS hosts, sum(n) AS n, sum(n * n) AS n2, {_MOMENTS} FROM h),
s AS (SELECT {_SHARES} FROM a),
z AS (SELECT {_SIZES} FROM s),
v AS (SELECT host, {_FAILS} AS bad FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM f JOIN v ON f.host = v.host
"""
