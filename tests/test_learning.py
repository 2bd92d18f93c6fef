import random

from strokeforge.operators import bpe

from test_operators import brute_learn, streams


def test_batches_give_what_one_by_one_gives(spark):
    r = random.Random(8)
    rows = [[1] + [min(int(r.expovariate(0.12)) + 200, 240) for _ in range(r.randrange(5, 60))] + [2] for _ in range(120)]
    rows += [[1] + [300, 301, 302] * 9 + [2]] * 5 + [[1] + [303] * 17 + [2]] * 4
    want, merged = brute_learn(rows, 60, 5561, 2)
    got = bpe.learn(streams(spark, rows), 60)
    assert got == want and len(got) == 60
    assert sorted(list(x.token_ids) for x in bpe.encode(streams(spark, rows), got).collect()) == sorted(merged)


def test_independent_pairs():
    # The third pair begins where the first ends; the fourth is as frequent as what comes after it.
    assert bpe.independent([(1, 2, 9), (3, 4, 8), (2, 5, 7)], 9, True) == [(1, 2), (3, 4)]
    assert bpe.independent([(1, 2, 9), (3, 4, 8), (5, 6, 7), (7, 8, 7)], 3, False) == [(1, 2), (3, 4)]
    assert bpe.independent([(1, 1, 9), (3, 4, 8)], 9, True) == [(1, 1)]
    assert bpe.independent([(1, 2, 9), (3, 3, 8), (4, 5, 1)], 9, True) == [(1, 2)]
    assert bpe.independent([(1, 2, 9), (3, 4, 9), (5, 6, 9)], 2, False) == [(1, 2)]
    assert bpe.independent([], 5, True) == []
