import random

import pytest
from pyspark.sql import functions as F

from strokeforge.functions import grammar
from strokeforge.operators import sampling

SCHEMA = "k int, token_ids array<int>"


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    rows = []
    for k in range(60):
        t = [1, 10, r.randrange(100, 140)]
        for _ in range(r.randrange(1, 6)):
            t += [14, *(r.randrange(100, 140) for _ in range(3)), 42] if r.random() < 0.4 else [11, r.randrange(100, 140)]
        rows.append((k, [*t, 17, 2]))
    return spark.createDataFrame(rows, SCHEMA)


def test_every_stream_is_valid_and_reruns_agree(spark, corpus):
    prompts = spark.createDataFrame([(k, p) for k in range(40) for p in [[1], [1, 14, 100], [1, 10, 5000], [7, 7], [1, 10, 100, 2], []]], SCHEMA).withColumn("k", F.monotonically_increasing_id())
    out = {r["k"]: r["token_ids"] for r in sampling.generate(prompts, corpus, "k", 12, 3).collect()}
    again = {r["k"]: r["token_ids"] for r in sampling.generate(prompts.repartition(3), corpus, "k", 12, 3).collect()}
    other = {r["k"]: r["token_ids"] for r in sampling.generate(prompts, corpus, "k", 12, 4).collect()}
    assert out == again and out != other and len(set(map(tuple, out.values()))) > 100
    df = spark.createDataFrame([(0, t) for t in out.values()], SCHEMA)
    assert df.filter(F.expr(f"NOT ({grammar.validated('token_ids')}).valid")).count() == 0


def test_draws_follow_weights(spark):
    streams = spark.createDataFrame([(i, [1, 10, 100 + (i % 10 > 6), 2]) for i in range(100)], SCHEMA)
    prompts = spark.range(4000).select(F.col("id").alias("k"), F.array(F.lit(1), F.lit(10)).alias("token_ids"))
    last = lambda **how: sampling.step(prompts.withColumn("_state", F.expr(sampling.state("token_ids"))), sampling.weights(streams), "k", 1, **how).groupBy(F.expr("token_ids[2]").alias("t")).count().collect()
    got = {r["t"]: r["count"] for r in last(top_p=1.0)}
    assert abs(got[100] / 4000 - 0.7) < 0.03 and got[100] + got[101] == 4000
    assert {r["t"] for r in last(top_k=1)} == {100} and {r["t"] for r in last(top_p=0.5)} == {100}


def test_null_prompts_and_no_streams(spark, corpus):
    out = sampling.generate(spark.createDataFrame([(1, None), (2, [1, 14])], SCHEMA), corpus.limit(0), "k", 8).collect()
    got = {r["k"]: r["token_ids"] for r in out}
    assert got[1] is None and got[2][:2] == [1, 14] and len(got[2]) == 6 and got[2][-1] == 2


def test_masks_are_made_by_kind_of_state_not_by_row(spark):
    prefixes = [[1], [1, 10], [1, 10, 140], [1, 10, 140, 31], [1, 10, 140, 42], [1, 20, 140, 2000], [1, 17], [1, 60], [1, 66], []]
    df = spark.createDataFrame(list(enumerate(prefixes)), SCHEMA)
    got = sampling.with_n_allowed(df, "token_ids")
    want = {r.k: r.n for r in df.select("k", F.expr(f"size(filter({grammar.mask('token_ids')}, v -> v))").alias("n")).collect()}
    assert {r.k: r.n_allowed for r in got.collect()} == want
    # One mask a kind, whatever the number of rows: the masks come from a table of as many rows.
    assert sorted(r.n_allowed for r in sampling.masks(spark).collect()) == [25, 41, 45, 5461]


def test_what_may_be_drawn_is_chosen_once_for_each_token_and_kind(spark, corpus):
    weighed = sampling.weights(corpus)
    got = {(r["last"], r["kind"]): r["kept"] for r in sampling.choices(weighed, 5, 0.8).collect()}
    states = F.expr(grammar.kinds())
    rows = weighed.select("last", "next", F.posexplode(states).alias("kind", "_state"))
    want = {(r["last"], r["kind"]): r["kept"] for r in rows.select("last", "kind", F.expr(sampling.kept("next", "_state", 5, 0.8)).alias("kept")).collect()}
    assert got == {k: v for k, v in want.items() if v} and max(map(len, got.values())) <= 5
