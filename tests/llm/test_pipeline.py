import hashlib
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from strokeforge.llm import langid, pieces

from .test_similar import shingles
from .test_text_operators import kept_lines

DIR = "/root/testdata/sf0.001"


def brute_mix(docs):
    """Rows as often as a block with their first word is taken: weights 3, 1, 2, half as much again in all, twice each source at most."""
    size = {d[0]: len((d[1] or "").encode().split()) for d in docs}
    sources = sorted({d[3] for d in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d[0]] for d in docs if d[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, free = {}, 1.5 * sum(total.values()), set(sources)
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= 2 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= full
    target |= {s: weight[s] * level for s in free}
    out = []
    for s in sources:
        at = 0
        for d in sorted((d for d in docs if d[3] == s), key=lambda d: (hashlib.md5(f"mix:{d[0]}".encode()).hexdigest(), d[0])):
            goal = math.floor(target[s] + 0.5)
            out += [d] * sum(at + e * total[s] < goal for e in (0, 1) if size[d[0]])
            at += size[d[0]]
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, DIR).write.parquet(path)
        out.append(([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()], docs := spark.read.parquet(path)))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def test_names_and_columns(spark, stages):
    assert len(stages) == 5
    for _, df in stages[:-1]:
        assert sorted(df.columns) == sorted(spark.read.parquet(f"{DIR}/documents.parquet").columns)
    assert corpus_pipeline.run(spark, DIR).count() == stages[-1][1].count()


def test_language(spark, stages):
    before, after = stages[0]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    found = {r.doc_id: r for r in langid.identify(docs, docs.filter(~langid.held_out())).collect()}
    assert rows(after) == sorted((d for d in before if found[d[0]].lang_pred != "und" and found[d[0]].bits_per_byte <= 7), key=str)
    assert len(before) - after.count() <= 0.02 * len(before)


def test_lines(stages):
    before, after = stages[1]
    want = [(d[0], text, d[2], d[3], len(text)) for d, text in zip(before, kept_lines(before), strict=True)]
    assert rows(after) == sorted(want, key=str)


def test_near_duplicates(stages):
    """One document of each group linked by five-word shingles at a similarity of 0.8, whatever their fingerprints."""
    before, after = stages[2]
    sets = [shingles(d[1]) for d in before]
    least = {d[0]: d[0] for d in before}
    links = [(a[0], b[0]) for i, (a, x) in enumerate(zip(before, sets, strict=True)) for b, y in zip(before[:i], sets, strict=False) if 5 * len(x & y) >= 4 * len(x | y)]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert rows(after) == sorted((d for d in before if least[d[0]] == d[0]), key=str)
    assert after.count() < len(before)


def test_mixing(stages):
    before, after = stages[3]
    assert rows(after) == sorted(brute_mix(before), key=str)


def test_pieces(stages):
    import sentencepiece

    before, after = stages[4]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    got = sorted((r.doc_id, tuple(r.token_ids), r.ids_sha256, r.round_trip) for r in after.collect())
    want = sorted((d[0], tuple(ids := sp.encode(d[1])), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True) for d in before)
    assert got == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, digest long, part int, _row string, copies int"


def odd_rows():
    r = random.Random(12)
    words = "the of and a cat dog house tree walked saw green old small many people water".split()
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    row = lambda i, t, source="s0": (i, t, "en", source, len(t or ""), "x", 1, 2, "y", 3)
    data = [row(i, "\n".join(prose(12) for _ in range(4)), f"s{i % 3}") for i in range(40)]
    data += [row(100, None), row(101, ""), row(102, " \n\n\n "), row(103, "12 34"), row(None, prose(40)), row(104, prose(30), None)]
    data += [data[3], data[3], row(3, prose(50)), row(105, data[5][1]), row(106, data[5][1] + " more")]
    long = "\n".join(prose(20) for _ in range(3000))
    return [*data, row(107, long), row(108, long + " end"), row(109, "the old cat\n" * 20_000)]


def test_run_meets_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    spark.createDataFrame(odd_rows(), ODD).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(path := f"{tmp_path}/stage{k}")
        before, docs = [r.asDict() for r in docs.collect()], spark.read.parquet(path)
        if k < 4:
            assert docs.columns == [f.split()[0] for f in ODD.split(", ")]
        sizes[name] = (before, [r.asDict() for r in docs.collect()])
    before, after = sizes["language ID"]
    assert {d["doc_id"] for d in before} - {d["doc_id"] for d in after} == {100, 101, 102, 103} and len(after) == len(before) - 4
    before, after = sizes["line dedup"]
    assert sorted((d["doc_id"] is None, d["doc_id"] or 0, d["text"]) for d in after) == sorted((d["doc_id"] is None, d["doc_id"] or 0, t) for d, t in zip(before, kept_lines([(x["doc_id"], x["text"]) for x in before]), strict=True))
    before, after = sizes["SimHash near-dedup"]
    # One row of each group of similar texts, the one of the least id.
    texts = sorted({d["text"] for d in before})
    group = {t: t for t in texts}
    sets = {t: shingles(t) for t in texts}
    links = [(t, u) for i, t in enumerate(texts) for u in texts[:i] if 5 * len(sets[t] & sets[u]) >= 4 * len(sets[t] | sets[u])]
    while any(group[t] != group[u] for t, u in links):
        for t, u in links:
            group[t] = group[u] = min(group[t], group[u])
    least = {}
    for d in before:
        key = (d["doc_id"] is not None, d["doc_id"] or 0)
        least[group[d["text"]]] = min(least.get(group[d["text"]], key), key)
    assert sorted((d["doc_id"] is not None, d["doc_id"] or 0) for d in after) == sorted(least.values()) and len(after) < len(before)
    before, after = sizes["mixing sources"]
    assert {(d["doc_id"], d["text"]) for d in after} <= {(d["doc_id"], d["text"]) for d in before if (d["text"] or "").split()}
    before, after = sizes["SentencePiece"]
    assert len(after) == len(before) and all(d["round_trip"] for d in after)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], ODD).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
