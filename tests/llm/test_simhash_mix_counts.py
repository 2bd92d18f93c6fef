import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strokeforge.llm import common, components, mixing, simhash, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, k long"


def rows(n=120, seed=1):
    r = random.Random(seed)
    words = ["a", "Bé", "the", "of", "x1", "wörd", "long" * 9]
    base = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 40, 90]))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        t = r.choice(base)
        if r.random() < 0.3 and t:
            t = t + r.choice([" tail", "\n the", " x"])
        out.append((i * 3, t, "en", r.choice(["s0", "s0", "s1", "é", None]), len(t), "clash", 7))
    return [*out, (1, None, None, None, None, None, None), (4, "", "fr", "s1", 0, "", 0), (7, "twice", "en", "s1", 5, "", 0), (7, "twice", "en", "s1", 5, "", 0)]


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_against_brute_force(spark):
    data = rows()
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    fp = [(d[0], brute_fp(d[1])) for d in data]
    comp = {d: d for d, _ in fp}
    for _ in range(len(fp)):
        old = dict(comp)
        for d, f in fp:
            comp[d] = min(comp[x] for x, g in fp if (f ^ g).bit_count() <= 3)
        if old == comp:
            break
    assert got == {(d, f"{f:016x}", comp[d]) for d, f in fp}
    assert simhash.near_duplicates(spark.createDataFrame(data, SCHEMA)).count() == len(data)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forest_spans_all_links():
    g = np.random.default_rng(3)
    base = g.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = base[:, None] ^ (np.uint64(1) << g.integers(0, 64, (300, 4)).astype(np.uint64))
    x = np.unique(np.concatenate([base, flips.ravel()]))

    def classes(pairs):
        root = np.arange(len(x))
        at = {int(v): i for i, v in enumerate(x)}
        simhash._join(root, np.array([at[int(a)] for a, _ in pairs], int), np.array([at[int(b)] for _, b in pairs], int))
        return root.tolist()

    brute = [(a, b) for i, a in enumerate(x) for b in x[i + 1 :] if int(a ^ b).bit_count() <= 3]
    assert classes(simhash.forest(x, None)) == classes(brute)
    half = len(x) // 2
    parts = np.concatenate([simhash.forest(x[:half], None), simhash.forest(x[half:], None), simhash.forest(x[:half], x[half:])])
    assert classes(parts) == classes(brute)


def test_links_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_LEAST", 8)
    data = rows(300, 5)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    monkeypatch.undo()
    assert got == {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}


def test_components_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == dict.fromkeys(range(1, 201), 0)


@pytest.mark.parametrize("data", [rows(), [], [(1, None, None, None, None, None, None)]])
def test_mixing(spark, data):
    docs = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(docs, block=16).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((d[0], len((d[1] or "").encode().split())) for d in data)
    by = {}
    for r, d in [(r, next(d for d in data if d[0] == r.doc_id)) for r in got]:
        s = by.setdefault(d[3], [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r.size
        assert 0 <= r.taken <= 2 * r.size
    for taken, size, target, source_size in by.values():
        assert size == source_size and abs(taken - target) <= 0.5 and target <= 2 * size + 1e-6
    if len(by) > 1:
        total = sum(s[1] for s in by.values())
        assert abs(sum(s[2] for s in by.values()) - 1.5 * total) < 1e-3
        order = sorted(by, key=lambda s: (s is None, s or ""))
        level = [by[s][2] / [3, 1, 2][i % 3] for i, s in enumerate(order) if by[s][2] < 2 * by[s][3] - 1e-6]
        assert max(level) - min(level) < 1e-3
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs, block=16).collect()))


def test_mix_prefix_holds_target_shares(spark):
    data = [(i, "w " * 50, "en", f"s{i % 3}", 100, "", 0) for i in range(300)]
    _, mixed = mixing.pieces(spark.createDataFrame(data, SCHEMA), block=50)
    slots = sorted((r.slot, r.k, r.words) for r in mixed.collect())
    total = sum(x[2] for x in slots)
    assert total == 22500
    half = [x for x in slots if x[0] < slots[-1][0] // 2]
    for k, w in (("0s0", 3), ("0s1", 1), ("0s2", 2)):
        part = sum(x[2] for x in slots if x[1] == k) / total
        assert abs(sum(x[2] for x in half if x[1] == k) / sum(x[2] for x in half) - part) < 0.02, (k, w)


def test_mix_rows_repeat_whole_rows(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    out = mixing.mix_rows(docs, block=16)
    assert out.columns == docs.columns
    kept = [tuple(r) for r in out.collect()]
    assert set(kept) <= set(data) and all(kept.count(r) <= 2 * data.count(r) for r in set(kept))


def library_counts(texts, name):
    from public_tokenizers import path

    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path(name))
        return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path(name))
    return [len(p.encode(x)) for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_and_cache(spark, tmp_path, name):
    from public_tokenizers import path

    data = [*rows(), (900, "special <|endoftext|> inside", "en", "s", 1, "", 0), (901, "x " * 3000, "en", "s", 1, "", 0)]
    docs = spark.createDataFrame(data, SCHEMA)
    cache = str(tmp_path / "cache")
    half = docs.filter("doc_id % 2 = 0")
    token_counts.token_counts(half, cache, path(name)).collect()
    before = spark.read.parquet(cache).count()
    assert before == half.select(F.coalesce("text", F.lit(""))).distinct().count()
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, cache, path(name)).collect())
    texts = [d[1] or "" for d in data]
    want = sorted((d[0], len(t.encode()), n, n > 2048) for d, t, n in zip(data, texts, library_counts(texts, name), strict=True))
    assert got == want
    assert spark.read.parquet(cache).count() == len(set(texts))  # misses only
    assert token_counts.token_counts(docs.limit(0), cache, path(name)).count() == 0


@pytest.mark.parametrize("hot", [10_000, 100])
def test_token_counts_of_null_and_repeated_ids(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_LEAST", hot)
    data = [(None, f"text {i % 4000}") for i in range(10_000)] + [(7, "the same row")] * 500 + [(7, "another"), (7, None), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    got = token_counts.token_counts(docs, str(tmp_path / "cache"))
    texts = [t or "" for _, t in data]
    want = sorted((d or -1, len(t.encode()), n) for (d, _), t, n in zip(data, texts, library_counts(texts, "word_bpe_49k.json"), strict=True))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got.collect()) == want


def test_word_counter_equals_the_library(monkeypatch):
    from public_tokenizers import path

    name = path("word_bpe_49k.json")
    assert token_counts.WordCounter.suits(name) and not token_counts.WordCounter.suits(path("byte_bpe_50k.json"))
    count = token_counts.counter(name)
    monkeypatch.setattr(token_counts.WordCounter, "KEPT", 50)
    monkeypatch.setattr(token_counts.WordCounter, "RECENT", 40)
    r = random.Random(8)
    near = [chr(c) for c in range(1, 0x260)]
    texts = ["".join(r.choice(near) for _ in range(60)) for _ in range(300)]
    texts += ["".join(r.choice("abc'stredmlv 012²½\n\x85\xa0\x1c\x1fÉßµªº_-.,!") for _ in range(80)) for _ in range(300)]
    texts += ["".join(r.choice("aΣσςİIıé e\u0301日本語😀 \u2028") for _ in range(30)) for _ in range(100)]
    texts += ["", " ", "<|endoftext|>", "x<|startoftext|>y <| z", "It's we'll I'D they'RE", "a" * 5000]
    texts += [x.text for x in __import__("pyarrow.parquet", fromlist=["x"]).read_table("/root/testdata/sf0.001/documents.parquet").to_pandas().itertuples()]
    assert count(texts) == library_counts(texts, "word_bpe_49k.json")


def test_mixing_spreads_rows_of_null_ids(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, id, cast(NULL AS LONG)) AS doc_id", "repeat('w ', 1 + cast(id % 4 AS INT)) AS text", "concat('s', id % 2) AS source")
    out = mixing.mix(docs).collect()
    assert len(out) == 3000 and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    for source in {r["source_size"] for r in out}:
        taken = sum(r["taken"] for r in out if r["source_size"] == source)
        assert abs(taken - sum({r["target"] for r in out if r["source_size"] == source})) <= 1
    from strokeforge.llm.scans import ranged

    parts = ranged(mixing.sized(docs).withColumn("row", mixing.F.monotonically_increasing_id()), ["k", "key", "size", "row"]).groupBy("_part").count().collect()
    assert max(r["count"] for r in parts) < 1000
