"""Generation of token streams under the grammar: all prompts take a step at once.

Next tokens are weighed by how often they follow the last one in given streams. Of those that
the grammar's state admits the TOP_K most frequent are kept, of these the fewest that hold the
share TOP_P, and one is drawn in proportion to its weight: that of the least -ln(u) / weight,
with u from the MD5 of seed, key, place and token, so that reruns agree and no order matters.

What may be drawn depends on the last token and the kind of state only, so it is chosen once for
each of these, not for each prompt: a step joins prompts with a table of at most TOP_K choices a
row, a row for each token and kind. It is broadcast up to BROADCAST choices, else shuffled.

Defined results: where no weighed token is admitted, a pending argument takes a coordinate by
hash, anything else ends the stream; streams that have ended stay; prompts that aren't valid so
far are repaired first; null prompts stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar, ids
from ..functions.sqlgen import let
from ..sources.shared import materialize

TOP_K, TOP_P = 50, 0.95
BROADCAST = 2_000_000
#: Steps in one plan.
CUT = 8
NEXT = "array<struct<w:bigint,t:int>>"


def weights(streams: DataFrame, tokens: str = "token_ids") -> DataFrame:
    """last, next: the tokens that follow a token, with their numbers w, from the most frequent on."""
    pairs = streams.select(F.explode(F.expr(f"transform(sequence(1, size({tokens}) - 1), i -> named_struct('a', {tokens}[i - 1], 't', {tokens}[i]))")).alias("p")).filter("p IS NOT NULL")
    counts = pairs.groupBy(F.col("p.a").alias("last"), F.col("p.t").alias("t")).agg(F.count("*").alias("w"))
    # At most the vocabulary's size a row.
    return counts.groupBy("last").agg(F.expr("array_sort(collect_list(struct(w, t)), (x, y) -> CASE WHEN x.w <> y.w THEN IF(x.w > y.w, -1, 1) ELSE x.t - y.t END)").alias("next"))


def state(tokens: str) -> str:
    """SQL: the grammar's state after a prompt that begins with BOS."""
    return grammar.reached(tokens)


def masks(spark: SparkSession, size: int = ids.VOCAB) -> DataFrame:
    """kind, mask, n_allowed: what the states of each kind admit."""
    rows = spark.range(1).select(F.posexplode(F.expr(grammar.kinds())).alias("kind", "s"))
    return rows.select("kind", F.expr(grammar.masked("s", size)).alias("mask")).withColumn("n_allowed", F.expr("size(filter(mask, v -> v))"))


def with_n_allowed(df: DataFrame, tokens: str, name: str = "n_allowed") -> DataFrame:
    """df with the number of ids that may follow a prefix that begins with BOS; masks are made once for each kind of state."""
    rows = df.withColumn("_kind", F.expr(f"element_at(transform(array({grammar.reached(tokens)}), s -> {grammar.kind()}), 1)"))
    counts = masks(df.sparkSession).select(F.col("kind").alias("_kind"), F.col("n_allowed").alias(name))
    return rows.join(F.broadcast(counts), "_kind").drop("_kind")


def kept(choices: str, state_: str, top_k: int, top_p: float) -> str:
    """SQL: the choices (w, t) that may be drawn in a state."""
    able = f"slice(filter({choices}, c -> {grammar.allowed('c.t', state_)}), 1, {top_k})"
    before = "aggregate(slice(ab, 1, i), 0L, (n, c) -> n + c.w)"
    return let({"ab": able, "al": "aggregate(ab, 0L, (n, c) -> n + c.w)"}, f"filter(ab, (x, i) -> i = 0 OR {before} < {top_p!r}D * al)", NEXT)


def uniform(*parts: str) -> str:
    """SQL: a number in (0, 1) from the MD5 of parts."""
    return f"((cast(conv(substring(md5(concat_ws(':', {', '.join(parts)})), 1, 13), 16, 10) AS DOUBLE) + 0.5D) / {2**52}D)"


def drawn(choices: str, key: str, place: str, seed: int) -> str:
    """SQL: the token drawn from choices (w, t), or null if there are none."""
    return f"array_min(transform({choices}, c -> named_struct('e', -ln({uniform(str(seed), key, place, 'c.t')}) / c.w, 't', c.t))).t"


def choices(weighed: DataFrame, top_k: int = TOP_K, top_p: float = TOP_P) -> DataFrame:
    """last, kind, kept: what may be drawn after a token in states of a kind; weighed is what weights() gives."""
    rows = weighed.select("last", "next", F.posexplode(F.expr(grammar.kinds())).alias("kind", "_state"))
    return rows.select("last", "kind", F.expr(kept("next", "_state", top_k, top_p)).alias("kept")).filter("size(kept) > 0")


def step(prompts: DataFrame, weighed: DataFrame, key: str, seed: int = 0, top_k: int = TOP_K, top_p: float = TOP_P, small: bool = True) -> DataFrame:
    """prompts (key, token_ids, _state) with one more token, and the state after it."""
    return drawn_step(prompts, choices(weighed, top_k, top_p), key, seed, small)


def drawn_step(prompts: DataFrame, chosen: DataFrame, key: str, seed: int, small: bool) -> DataFrame:
    """step() over what choices() gives."""
    told = chosen.select(F.col("last").alias("_last"), F.col("kind").alias("_kind"), F.col("kept").alias("_kept"))
    rows = prompts.withColumns({"_last": F.expr("get(token_ids, size(token_ids) - 1)"), "_kind": F.expr(grammar.kind("_state"))})
    rows = rows.join(F.broadcast(told) if small else told, ["_last", "_kind"], "left").withColumn("_kept", F.expr(f"coalesce(_kept, cast(array() AS {NEXT}))"))
    place = "size(token_ids)"
    other = f"IF(_state.pending > 0, {ids.BASE} + cast(floor({uniform(str(seed), key, place)} * {ids.VOCAB - ids.BASE}) AS INT), 2)"
    rows = rows.withColumn("_t", F.expr(f"IF(token_ids IS NULL OR _last = 2, NULL, coalesce({drawn('_kept', key, place, seed)}, {other}))"))
    moved = f"element_at(transform(array(named_struct('s', _state, 't', _t)), z -> {grammar.struct(grammar.advance('z.t', 'z.s'))}), 1)"
    rows = rows.withColumns({"_state": F.expr(f"IF(_t IS NULL, _state, {moved})"), "token_ids": F.expr("IF(_t IS NULL, token_ids, concat(token_ids, array(_t)))")})
    return rows.select(*prompts.columns)


def generate(prompts: DataFrame, streams: DataFrame, key: str, steps: int = 64, seed: int = 0, top_k: int = TOP_K, top_p: float = TOP_P) -> DataFrame:
    """prompts (key, token_ids from BOS on) completed as streams do, each by steps tokens at most; every one is valid."""
    chosen = materialize(choices(weights(streams), top_k, top_p), "sampling")
    small = (chosen.agg(F.sum(F.size("kept"))).first()[0] or 0) <= BROADCAST
    open_ = f"slice({grammar.repaired('token_ids')}, 1, size({grammar.repaired('token_ids')}) - 1)"
    # A prompt that is cut within a command is one that repair would shorten: it is kept if all that it holds is admitted.
    fine = f"aggregate(slice(token_ids, 2, greatest(size(token_ids) - 1, 0)), named_struct('ok', get(token_ids, 0) = 1, 's', {grammar.struct(grammar.START)}), (z, t) -> named_struct('ok', z.ok AND {grammar.allowed('t', 'z.s')}, 's', {grammar.struct(grammar.advance('t', 'z.s'))}), z -> z.ok)"
    rows = prompts.withColumn("token_ids", F.expr(f"IF(token_ids IS NULL, NULL, IF(coalesce({fine}, false), token_ids, {open_}))")).withColumn("_state", F.expr(state("token_ids")))
    for i in range(steps):
        rows = drawn_step(rows, chosen, key, seed, small)
        if (i + 1) % CUT == 0:
            rows = materialize(rows, "sampled")
    # What is still open after the last step is cut back to whole groups and closed.
    return rows.drop("_state").withColumn("token_ids", F.expr(f"IF(get(token_ids, size(token_ids) - 1) = 2, token_ids, {grammar.repaired('token_ids')})"))
