import random

import numpy as np
import xxhash

from strokeforge.llm import common, similar, simhash

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(data, radius=64):
    sets = [shingles(t) for _, t in data]
    fp = []
    for _, t in data:
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))] if w else []
        fp.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    n, least = len(data), [d for d, _ in data]
    links = [(i, j) for i in range(n) for j in range(i) if sets[i] == sets[j] or (len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4 and (fp[i] ^ fp[j]).bit_count() <= radius)]
    while True:
        old = list(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
        if old == least:
            return [(d, c) for (d, _), c in zip(data, least, strict=True)]


def edited(seed=4):
    """Texts of 60 words and copies with one to three words changed, around a similarity of 0.8."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([60, 90, 150]))]
        for _ in range(4):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = word()
            out.append((len(out) * 2 + 3, " ".join(w)))
    return [*out, (200, ""), (201, None), (202, "one two"), (203, "one two"), (204, " ".join(["x"] * 50))]


def test_near_copies_against_brute_force(spark):
    data = edited()
    got = sorted((r.doc_id, r.component_id) for r in similar.near_copies(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == sorted(brute(data, similar.RADIUS))
    assert sum(d == c for d, c in got) < len(data) - 10
    wide = sorted((r.doc_id, r.component_id) for r in similar.near_copies(spark.createDataFrame(data, SCHEMA), 64).collect())
    assert wide == sorted(brute(data))


def test_stage_removes_edited_copies(spark):
    w = [f"w{i}" for i in range(60)]
    data = [(1, " ".join(w)), (2, " ".join([*w[:20], "other", *w[21:]])), (3, " ".join(w[::-1]))]
    out = simhash.simhash_stage(spark, spark.createDataFrame(data, SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_LEAST", 4)
    monkeypatch.setattr(similar, "LEFT", 2)
    data = edited(5)
    got = sorted((r.doc_id, r.component_id) for r in similar.near_copies(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == sorted(brute(data, similar.RADIUS))


def test_stage_of_nulls_repeats_and_empty_tables(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(30))
    schema = "doc_id long, text string, th long, oid string, node int, copies int"
    row = lambda i, t: (i, t, 1, "x", 2, 3)
    data = [row(5, text), row(5, text), row(5, text + " more"), row(6, text.upper()), row(2, ""), row(1, None), row(1, None), row(3, " \n"), row(None, "all alone here"), row(None, "all alone here"), row(9, "all alone here")]
    docs = spark.createDataFrame(data, schema)
    for hot in (10_000, 1):
        monkeypatch.setattr(common, "HOT_LEAST", hot)
        out = simhash.simhash_stage(spark, docs, "")
        assert out.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert got[1:] in ([(None, "all alone here")], [(5, text), (None, "all alone here")], [(5, text + " more"), (None, "all alone here")]) and got[0] == (1, None)
        assert len(got) == 3
    assert simhash.simhash_stage(spark, docs.limit(0), "").count() == 0
    assert similar.near_copies(docs.limit(0)).count() == 0


def test_parities_reject_no_link():
    r = random.Random(8)
    for _ in range(200):
        n = r.choice([5, 40, 400, 3000])
        x = np.array([r.getrandbits(64) for _ in range(n)], np.uint64)
        y = np.concatenate([x[: n - n // 9], np.array([r.getrandbits(64) for _ in range(r.choice([n // 9, n // 5 + 1]))], np.uint64)])
        odd = similar.folded([similar.parities(x), similar.parities(y)])
        assert similar._apart(odd, np.array([0]), np.array([1]))[0] <= len(set(x.tolist()) ^ set(y.tolist()))
        assert odd.shape[1] * 64 == min(similar.buckets(len(x)), similar.buckets(len(y)))
