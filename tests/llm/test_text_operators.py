import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from strokeforge.llm import common, langid, line_dedup, pieces, simhash, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, w int, row string"


def doc(i, text, lang="en"):
    return (i, text, lang, "s", len(text or ""), "clash", 3, "x")


def brute_bits(model_texts, data, order=3):
    """Code length of data by PPM with escape method C and exclusion, in plain dictionaries."""
    counts = defaultdict(Counter)
    for t in model_texts:
        padded = [None] * order + list(t)
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[tuple(padded[i - k : i])][padded[i]] += 1

    def p(context, byte):
        longer = {b: 1 / 256 for b in range(256)} if not context else None
        seen = counts.get(context)
        if longer is None:
            longer = dist(context[1:])
        if not seen:
            return longer[byte]
        n, d = sum(seen.values()), len(seen)
        rest = sum(q for b, q in longer.items() if b not in seen)
        return seen[byte] / (n + d) if byte in seen else d / (n + d) * longer[byte] / rest

    memo = {}

    def dist(context):
        if context not in memo:
            memo[context] = {b: p(context, b) for b in range(256)}
        return memo[context]

    padded = [None] * order + list(data)
    return -sum(math.log2(dist(tuple(padded[i - order : i]))[padded[i]]) for i in range(order, len(padded)))


@pytest.mark.parametrize("dense_bytes", [langid.DENSE_BYTES, 0])
def test_code_lengths_are_exact(monkeypatch, dense_bytes):
    monkeypatch.setattr(langid, "PIECE", 7)
    r = random.Random(4)
    sample = {"a": [b"the cat sat on the mat", "été là".encode(), b"abab"], "b": [b"der hund und die katze", b"q"]}
    m = langid.Model(sample, dense_bytes=dense_bytes)
    assert m.dense == (dense_bytes > 0)
    texts = [b"", b"the", b"a", "hünd zz été".encode(), bytes(r.randrange(256) for _ in range(40)), b"", b"katze und cat"]
    starts = np.cumsum([0] + [len(t) for t in texts])
    bits = m.bits(np.frombuffer(b"".join(texts), np.uint8), starts)
    for i, t in enumerate(texts):
        for j, lang in enumerate(m.languages):
            assert bits[i, j] == pytest.approx(brute_bits(sample[lang], t), rel=1e-5)


def test_language_id_cases(spark):
    en, de = "the cat and the dog sat on that mat with them. ", "der hund und die katze sind nicht auf der matte. "
    data = [doc(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(60)]
    data += [doc(100, None, None), doc(101, "", "en"), doc(102, "12 34 !!", "en"), doc(103, en * 4000, None), doc(3, data[3][1], "en"), (None, en, "en", None, 1, "", 1, "")]
    docs = spark.createDataFrame(data, SCHEMA)
    got = langid.identify(docs, docs.filter("doc_id < 50"))
    rows = {(r.doc_id, r.lang_pred) for r in got.collect()}
    assert got.count() == len(data)
    assert {(100, "und"), (101, "und"), (102, "und"), (103, "en"), (None, "en")} <= rows
    assert all(lang == ("en" if i % 2 else "de") for i, lang in rows if i is not None and i < 60)
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert {r.lang_pred for r in langid.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), docs).count() == 0
    stage = langid.language_stage(spark, docs, "")
    assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == {d[0] for d in data} - {100, 101, 102}


def test_every_label_is_learned(spark):
    """A hundred labels, three huge documents of one language, one text that repeats, a text of one letter."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(40)]
    data = [(i, " ".join(r.choice(words) + f" l{i % 100}" for _ in range(30)), f"l{i % 100:02}") for i in range(300)]
    data += [(1000 + i, f"grand texte numéro {i} " * 150_000, "huge") for i in range(3)]
    data += [(2000 + i, "the very same text each time " * 40_000, "same") for i in range(40)]
    data += [(3000, "q", "one"), (3001, None, "none"), (3002, "", "none")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    sample = langid.training_sample(docs)
    assert set(sample) == {d[2] for d in data} - {"none"}
    assert all(v and sum(map(len, v)) <= langid.TOTAL_BYTES // len(sample) + langid.CHUNK * 4 for v in sample.values())
    assert sum(map(len, sample["huge"])) > 50_000 and sum(map(len, sample["same"])) > 10_000
    got = {x.doc_id: x.lang_pred for x in langid.identify(docs.filter("doc_id < 1003 OR doc_id >= 2039"), docs).collect()}
    assert got[1000] == "huge" and got[2039] == "same" and got[3001] == "und"
    assert sum(got[i] == f"l{i % 100:02}" for i in range(300)) > 290


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op3_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").select("lang", "lang_pred").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


def brute_lines(data):
    """For each row the numbers of its lines that later occurrences of three-line windows cover."""
    seen, gone = set(), [set() for _ in data]
    order = [i for i, d in enumerate(data) if d[1] is not None]
    for r in sorted(order, key=lambda i: (data[i][0] is not None, data[i][0] or 0, int(hashlib.md5(data[i][1].encode()).hexdigest()[:15], 16))):
        lines = data[r][1].split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone[r] |= {i, i + 1, i + 2}
            seen.add(w)
    return gone


def kept_lines(data):
    return [None if d[1] is None else "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in g) for d, g in zip(data, brute_lines(data), strict=True)]


def line_cases():
    r = random.Random(2)
    lines = ["a", "b", "", " ", "cc", "é", "dd"]
    data = [doc(i, "\n".join(r.choice(lines) for _ in range(r.randrange(12)))) for i in range(60)]
    data += [doc(90, None), doc(91, "one\ntwo"), doc(92, "x\n" * 5000), doc(93, "q\nw\ne"), doc(93, "q\nw\ne"), doc(94, "\n\n\n\n\n"), doc(95, "q\nw\ne\nr")]
    return data + [doc(96, "m\nn\no\np")] * 3 + [doc(96, "other\ntext\nhere"), doc(None, "u\nv\nw"), doc(None, "u\nv\nw"), doc(None, "u\nv\nz"), doc(97, ""), doc(97, "")]


@pytest.mark.parametrize("hot", [10_000, 2])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_LEAST", hot)
    data = line_cases()
    docs = spark.createDataFrame(data, SCHEMA)
    out = line_dedup.dedup_lines(docs.repartition(5))
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=key) == sorted(zip([d[0] for d in data], kept_lines(data), strict=True), key=key)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    stage = line_dedup.line_stage(spark, docs, "")
    assert stage.columns == docs.columns and all(x.n_chars == (None if x.text is None else len(x.text)) for x in stage.collect())


def test_line_sql_tells_rows_apart(spark, tmp_path):
    import duckdb

    data = line_cases()
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = line_dedup.op10_line_dedup(spark, str(tmp_path))
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(con.sql(line_dedup.SQL).fetchall(), key=key)


def brute_topk(data, k, every):
    exact = lambda x: math.floor(Fraction(x) * 256)
    ok = [(i, [exact(x) for x in v]) for i, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(ok):
        if q is not None and q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0) for n, (i, w) in enumerate(ok) if n != at)
            out += [(q, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(scores[:k])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, v int, q int, uid int, side int"


@pytest.mark.parametrize("block", [8, 64, None])
def test_topk(spark, block):
    g = np.random.default_rng(5)
    data = [(i, [float(np.float32(x)) for x in g.normal(0, 0.3, 6)]) for i in range(200)]
    data += [(300 + i, data[3][1]) for i in range(30)]
    data += [(400, None), (410, [None] * 6), (420, [float("nan")] * 6), (430, [float("inf")] + [0.0] * 5), (440, []), (450, [0.5]), (None, [1.0])]
    data += [(460, data[5][1]), (460, data[6][1]), (460, data[6][1])]  # rows that repeat an id
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in data], VECTORS)
    got = topk.top_k(df, 5, 10, block, 16)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(data, 5, 10)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id = 10"), 5, 10).count() == 0


@pytest.mark.parametrize("scale", [1e5, 1e6, 2.5e6])
def test_topk_of_large_components(spark, scale):
    g = np.random.default_rng(7)
    data = [(0, [scale]), (1, [scale]), (2, [2 * scale])] + [(i, [float(x) * scale for x in g.integers(-3, 4, 2)]) for i in range(3, 40)]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), 5, 3)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(data, 5, 3)


def test_topk_refuses_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="over 64 bits"):
        topk.top_k(df, 1, 3).collect()
    assert [tuple(r) for r in topk.top_k(df.filter("vec_id <> 1"), 1, 3).collect()] == [(0, 1, 2, 0)]


def test_topk_few_dimensions_stop_early():
    g = np.random.default_rng(6)
    x = np.floor(256 * g.standard_t(2, (4000, 3)))
    index = topk.Index(x)
    sizes = []
    for q in range(0, 200, 20):
        rows, scores = index.search(x[q], 5, q)
        b = x @ x[q]
        b[q] = -np.inf
        assert sorted(scores)[-5:] == sorted(b)[-5:]
        sizes.append(len(rows))
    assert max(sizes) < 1000


ODD = ["", " ", "  a", "a  ", "\n", "\t x\r\n", "日本語テキスト", "emoji 😀👍🏽", "<s> </s> <unk> <0x0A>", "1234 567", "\x00a", "ab" * 400, " " * 50, "word, word. x! www.a.b", " 　x"]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    t = pieces.Transducer.load(pieces.model_path())
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("abethin gsor .,\né'\"-=()ї한 字") for _ in range(150)) for _ in range(100)]
    for s in [*texts, "▁x ▁"]:
        ids = np.frombuffer(t.encode(s), "<i4").tolist()
        assert ids == sp.encode(s), s
        assert t.decode(ids).decode() == sp.decode(ids), s
    docs = spark.createDataFrame([doc(i, s) for i, s in enumerate(texts)] + [doc(1, None), doc(1, None)], SCHEMA)
    rows = pieces.encode_documents(docs, with_text=True).collect()
    assert len(rows) == len(texts) + 2 and all(x.round_trip and x.n_tokens == len(x.token_ids) for x in rows)
    assert {(x.doc_id, x.decoded) for x in rows} == {*enumerate(texts), (1, "")}
    assert pieces.encode_documents(docs.limit(0)).count() == 0


def test_unigram_paths_are_shortest():
    r = random.Random(3)
    vocab = {p: (i, -r.random() * 5) for i, p in enumerate(["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "bb"])}
    t = pieces.Transducer(vocab, None, 99, bpe=False)

    def best(s):
        if not s:
            return 0.0
        return min(([-vocab[s[:n]][1] + best(s[n:]) for n in range(1, len(s) + 1) if s[:n] in vocab]), default=math.inf)

    for _ in range(50):
        s = "▁" + "".join(r.choice("ab") for _ in range(r.randrange(1, 10)))
        assert sum(-t.score[t.text[i]] for i in t.shortest(s)) == pytest.approx(best(s))


def test_simhash_stage_keeps_one_of_each(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    data = [doc(1, base), doc(2, base), doc(2, base), doc(3, "something else entirely here and now and again"), doc(4, ""), doc(5, None), (None, "null id", None, None, 1, "", 1, "")]
    out = simhash.simhash_stage(spark, spark.createDataFrame(data, SCHEMA), "")
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 1), (False, 3), (False, 4), (True, None)]


def test_top_k_takes_vectors_of_null_ids(spark):
    rows = [(50, [1.0, 0.0]), (None, [2.0, 0.0]), (None, [1.5, 0.0]), (7, [2.0, 0.0])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in out) == [(1, 7, 131072), (2, None, 131072), (3, None, 98304)]
    many = spark.range(10_000).selectExpr("cast(NULL AS LONG) AS vec_id", "array(double(id), 1D) AS embedding")
    many = many.unionByName(spark.createDataFrame([(100, [1.0, 0.0])], "vec_id long, embedding array<double>"))
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(many).collect()) == [(i, None, 65536 * (10_000 - i)) for i in range(1, 6)]
