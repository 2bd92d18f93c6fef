import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strokeforge.llm import bwt, suffix_dedup

SCHEMA = "doc_id long, text string, d long, g long, runs string, n int"


def brute(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        spans = int((np.diff(np.concatenate([[0], gone[:-1], [0]])) == 1).sum()) if len(t) else 0
        kept = bytes(b for b, x in zip(t, gone, strict=False) if not x)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n // 5))[:n]
    shared = [prose(n) for n in (399, 400, 401, 430, 800, 1500)]
    texts = [None, "", "x" * 399, "x" * 400, "y" * 401, "z" * 1500, "ab" * 900, prose(5000)]
    for _ in range(60):
        texts.append("".join(r.choice([prose(r.randrange(300)), r.choice(shared), r.choice(shared)[r.randrange(60) :]]) for _ in range(r.randrange(4))))
    base = prose(3000)
    for _ in range(12):
        t = list(base)
        for _ in range(3):
            t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    texts += [base, base, shared[3], "q" + shared[3] + "w", shared[2] * 3]
    return texts


@pytest.mark.parametrize("seed,crowd", [(1, None), (2, 3), (3, 8)])
def test_against_brute_force(spark, seed, crowd):
    texts = corpus(seed)
    rows = [(i, t, 1, 2, "x", 3) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), crowd).collect())
    assert [g[1:] for g in got] == brute(texts)


def test_small_and_odd_tables(spark):
    r = random.Random(5)
    t = "".join(r.choice("abcdef") for _ in range(600))
    rows = [(1, t, 0, 0, "", 0), (1, t, 0, 0, "", 0), (None, t, 0, 0, "", 0), (2, t[:450], 0, 0, "", 0), (2, "short", 0, 0, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, 600, 600, 1), (1, 600, 600, 1), (None, 600, 600, 1), (2, 450, 450, 1), (2, 5, 0, 0)], key=str)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(df.filter("doc_id = 2")).filter("n_removed > 0").count() == 0


def test_pieces_of_long_texts_agree(monkeypatch):
    r = random.Random(9)
    t = "".join(r.choice("abc ") for _ in range(9000)).encode() + b"x" * 2000
    whole = [x.tolist() for x in suffix_dedup.anchors(t)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1024)
    assert [x.tolist() for x in suffix_dedup.anchors(t)] == whole
    starts = [s for a, b in zip(whole[2], whole[3], strict=True) for s in range(a, b + 1)]
    assert starts == list(range(len(t) - 399))


def test_merge_of_transforms_is_the_transform_of_all():
    r = random.Random(11)
    rows = [[r.randrange(1, 4) for _ in range(r.randrange(1, 12))] + [0] for _ in range(40)] + [[1, 2, 3, 0]] * 3
    deal = [r.randrange(3) for _ in rows]
    shards, where = [], []
    for s in range(3):
        own = [i for i, d in enumerate(deal) if d == s]
        starts = np.concatenate([[0], np.cumsum([len(rows[i]) for i in own])])
        shards.append(bwt.Shard(np.concatenate([rows[i] for i in own]), starts))
        where.append([(i, j) for i in own for j in range(len(rows[i]))])
    depth = 6
    who, block, common = bwt.merge(shards, depth)
    at = [0] * 3
    prefix = []
    for w in who:
        i, j = where[w][shards[w].order[at[w]]]
        at[w] += 1
        prefix.append(tuple(rows[i][(j + k) % len(rows[i])] for k in range(depth)))
    assert prefix == sorted(prefix)
    assert [prefix[i] == prefix[i - 1] for i in range(1, len(prefix))] == [block[i] == block[i - 1] for i in range(1, len(prefix))]
    lcp = [next((k for k in range(depth) if prefix[i][k] != prefix[i - 1][k]), depth) for i in range(1, len(prefix))]
    assert common[1:].tolist() == lcp
