import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from strokeforge.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, b string, next string"


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def data(n=90):
    r = random.Random(7)
    words = ["Wort", "wort", "the", "é", "x1", "ein", "and", "of"]
    out = [(i * 5 - 40, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 4, 5, 6, 60]))) + r.choice(["", " \n", "\x0b"]), "en", "s", 0, "", "") for i in range(n)]
    return [*out, (1, None, None, None, None, None, None), (2, "😀é" * 7, "", "", 0, "", ""), (3, " ".join(map(str, range(4000))), "", "", 0, "", ""), (7, "same", "", "", 0, "", ""), (7, "same", "", "", 0, "", "")]


def brute_sketch(text, k=fp.K):
    """The k least hashes of shingles in hexadecimal, by XXH64 chained from seed 42."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    words = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    out = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return "".join(f"{h % (1 << 64):016x}" for h in sorted(out)[:k])


def test_sketch_values(spark):
    rows = data()
    got = {(r.doc_id, r.x): r.s for r in fp.with_sketch(spark.createDataFrame(rows, SCHEMA).select("doc_id", F.coalesce("text", F.lit("")).alias("x")), "x", "s").select("doc_id", "x", fp.text_form(F.col("s")).alias("s")).collect()}
    assert got == {(d[0], d[1] or ""): brute_sketch(d[1]) for d in rows}


def test_many_rows_of_one_id(spark):
    """Ten thousand rows without an id, a third of them equal, and some ids that repeat with other texts."""
    texts = [f"text number {i % 50} of the nulls" for i in range(300)] + ["all alike"] * 9700
    rows = [(None, t) for t in texts] + [(5, "five a"), (5, "five b"), (5, "five b"), (9, None)]
    got = fp.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows)
    order = sorted({(d is not None, d or 0, xxhash.xxh64_intdigest((t or "").encode(), 42), t or "") for d, t in rows}, key=lambda x: (x[0], x[1], x[2] - (x[2] >> 63 << 64)))
    after = {x: y[3] for x, y in zip(order, order[1:] + order[:1], strict=True)}
    want = []
    for x in order:
        n = sum((d is not None, d or 0, t or "") == (x[0], x[1], x[3]) for d, t in rows)
        for u in [after[x]] + [x[3]] * (n - 1):
            h = len(x[3]) // 2
            want.append((x[1] if x[0] else None, hashlib.sha256((x[3][: len(x[3]) - h] + u[:h]).encode()).hexdigest(), round(jaccard(shingles(x[3]), shingles(u)), 9)))
    assert sorted(((r.doc_id, r.edited_sha256, round(r.near_next, 9)) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("repeats", [True, False])
def test_against_brute_force(spark, monkeypatch, repeats):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 8)
    rows = sorted(data() if repeats else data()[:-1], key=lambda x: x[0])
    out = fp.compare_with_next(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.edited_sha256): r for r in out}
    prints = {}
    for a, b in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = a[1] or "", b[1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + u[:h]
        r = got[a[0], hashlib.sha256(e.encode()).hexdigest()]
        assert r.n_chars == len(t)
        tol = 1e-9 if max(map(len, (shingles(t), shingles(e), shingles(u)))) <= fp.K else 0.2
        assert abs(r.near_edited - jaccard(shingles(t), shingles(e))) <= tol and abs(r.near_next - jaccard(shingles(t), shingles(u))) <= tol
        assert prints.setdefault(tuple(sorted(shingles(t))), r.fingerprint) == r.fingerprint
        n = len(shingles(t))
        assert abs(r.n_shingles - n) <= (0 if n < fp.K else 0.35 * n)
    assert len(set(prints.values())) == len(prints)


def test_small_tables(spark):
    one = spark.createDataFrame([(5, "only one here", "", "", 0, "", "")], SCHEMA)
    r = fp.compare_with_next(one).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"only on" + b"only o").hexdigest()
    assert fp.compare_with_next(one.limit(0)).count() == 0
    assert fp.compare_with_next(spark.createDataFrame([(None, None, "", "", 0, "", ""), (None, "a", "", "", 0, "", "")], SCHEMA)).count() == 2


def test_merge_and_containment(spark):
    a, b = " ".join(map(str, range(3000))), " ".join(map(str, range(1000, 4000)))
    rows = spark.createDataFrame([(i, t, "", "", 0, "g" if i < 200 else "h", "") for i, t in enumerate([a, b] * 150)], SCHEMA)
    s = fp.with_sketch(rows, "text", "k")
    m = {r.b: r for r in fp.merge_parts(s, "b", "k").withColumn("n", fp.distinct_shingles(F.col("k"))).collect()}
    assert abs(m["g"].n - 3992) < 1200 and list(m["g"].k) == list(m["h"].k)
    x = s.filter("doc_id = 0").select(F.col("k").alias("x")).crossJoin(s.filter("doc_id = 1").select(F.col("k").alias("y")))
    r = x.select(fp.containment(F.col("x"), F.col("y")), fp.resemblance(F.col("x"), F.col("y"))).first()
    assert abs(r[0] - 2 / 3) < 0.2 and abs(r[1] - 0.5) < 0.2
