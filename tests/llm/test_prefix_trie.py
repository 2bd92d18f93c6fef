import hashlib
import random
from zlib import crc32

from pyspark.sql import functions as F

from strokeforge.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % 6
        paths[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    kids = {n: [] for n in nodes}
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)

    def below(n):
        return [n] + [x for k in kids[n] for x in below(k)]

    out = []
    for n, members in nodes.items():
        sub = below(n)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(paths[c]) == len(n)))
        saved = sum((len(nodes[v]) - 1) * len(v[-1][1]) for v in sub if v)
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids[n]), sum(not kids[v] for v in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    return sorted((tuple(r[c] for c in NAMES) for r in pt.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()), key=str)


def test_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "user", None]), r.choice("ab") * r.randrange(3)) for c in r.sample(range(700), 160) for t in range(r.randrange(1, 9))]
    rows += [(c, t, "user", "hot") for c in range(1000, 1100) for t in range(7)]
    rows += rows[:30] + [(None, 1, "user", "x"), (5000, None, None, None), (5001, 3, "user", "é" * 9), (5001, 3, "user", "z")]
    rows += [(-5, 0, "user", "a"), (4242, 0, "x", "deep")] + [(4242, t, "x", str(t % 3)) for t in range(1, 90)]
    want = brute(rows)
    assert len(want) > 200 and got(spark, rows) == want


def test_intervals_nest(spark):
    rows = [(c, t, "u", str((c >> t) % 2)) for c in range(64) for t in range(8)]
    out = {r["preorder"]: r for r in pt.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(out) == list(range(1, len(out) + 1))
    stack = []
    for at in sorted(out):
        while stack and stack[-1] < at:
            stack.pop()
        assert out[at]["depth"] == len(stack) and (not stack or out[at]["subtree_end"] <= stack[-1])
        stack.append(out[at]["subtree_end"])


def test_a_chain_of_copies_and_one_long_conversation(spark):
    # Conversations 1, 2, ... are cut ever shorter; one holds a third of all rows.
    rows = [(100 * c, t, "u", "x") for c in range(1, 30) for t in range(60 - 2 * c)] + [(77, t, "u", str(t)) for t in range(600)]
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    assert got(spark, []) == []
    # A conversation that takes more turns than there are is turnless: h of 3 is 5 or so, and 0 is absent.
    few = [(c, 0, "u", "x") for c in range(1, 40)]
    assert got(spark, few) == brute(few)
    df = spark.createDataFrame([(7, 0, "u", "x")], SCHEMA).withColumns({"c": F.lit("y"), "k1": F.array(F.lit(1)), "_part": F.lit(None).cast("int"), "total": F.lit(2.0)})
    assert sorted((tuple(r[c] for c in NAMES) for r in pt.prefix_trie(df).collect()), key=str) == brute([(7, 0, "u", "x")])


def test_runs_of_ids_are_joined(spark, monkeypatch):
    monkeypatch.setattr(pt, "RUN", 3)
    rows = [(100 * c, 0, "u", "x") for c in range(1, 200)]
    assert got(spark, rows) == brute(rows)
