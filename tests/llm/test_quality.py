import random
import re

import pytest
from pyspark.sql import functions as F

from strokeforge.llm import quality as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for v in places.values() if len(v) > 1 for i in v for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(x in "#*$%&|<>" for x in text), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def brute(rows):
    """(doc_id, counts, base_failed, host_failed, kept) of rows (doc_id, text, source)."""
    each, hosts = [], {}
    for i, text, source in rows:
        c = counts(text)
        n = c["n_words"]
        fails = {
            "base": n < 20 or 100 * c["n_repeat_words"] > 30 * n, "symbols": n > 0 and 10 * c["n_symbols"] > n,
            "lines": c["n_lines"] > 0 and 10 * c["n_dup_lines"] > 3 * c["n_lines"], "length": n > 0 and not 2 * n <= c["word_chars"] <= 15 * n,
        }
        each.append((i, source, c, fails))
        hosts.setdefault(source, []).append(fails)
    bad = {s: [] for s in hosts}
    for rule in q.RULES:
        n, k = {s: len(v) for s, v in hosts.items()}, {s: sum(f[rule] for f in v) for s, v in hosts.items()}
        total, failed = sum(n.values()), sum(k.values())
        mean = failed / total
        spread = mean * (1 - mean)
        between = sum(n[s] * (k[s] / n[s] - mean) ** 2 for s in n) - spread * (len(n) - 1)
        within = total - sum(x * x for x in n.values()) / total - (len(n) - 1)
        share = between / (spread * within) if spread * within > 0 else 0
        size = 1 / min(max(share, 1e-9), 1 - 1e-9) - 1
        for s in hosts:
            if (k[s] + mean * size) / (n[s] + size) > q.RATE:
                bad[s].append(rule)
    return sorted(((i, tuple(c.values()), f["base"], tuple(bad[s]), not f["base"] and not bad[s]) for i, s, c, f in each), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, None, s, 1) for i, t, s in rows], SCHEMA).repartition(4)
    out = q.judge(df, ["doc_id"]).collect()
    return sorted(((r["doc_id"], tuple(r["_quality"][c] for c in q.COUNTS), r["_quality"]["base_failed"], tuple(r["_quality"]["host_failed"]), r["_quality"]["kept"]) for r in out), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdéfghijklmnop" * 2 + "#") for _ in range(r.randrange(1, 6)))
    out = []
    for i in range(300):
        host = r.choice(["good", "good", "bad", "odd", None, f"h{i}"])
        few = host == "bad" and r.random() < 0.8
        text = " ".join(word() for _ in range(r.randrange(3, 12) if few else r.randrange(20, 90)))
        if r.random() < 0.3:
            text = text + "\n" + text[: len(text) // 2] + "\t\n \n" + text
        out.append((i if r.random() > 0.05 else None, text if r.random() > 0.03 else None, host))
    return out + out[:20] + [(900, "", "good"), (901, "x " * 500, "odd"), (902, "\n".join(["# *"] * 40), "odd"), (903, "    ", "good")]


def test_equals_brute_force(spark, rows):
    want = brute(rows)
    assert got(spark, rows) == want
    assert {r for w in want for r in w[3]} and any(not w[2] and not w[4] for w in want) and any(w[4] for w in want)


def test_small_hosts_are_shrunk(spark):
    # One bad document of a host that has no other does not condemn the host; a large host's rate does.
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 10 else "short", f"host{i // 10 % 30}") for i in range(1500)] + [(2000 + i, "short", "bad") for i in range(60)] + [(3000, good, "bad"), (3001, "short", "small"), (3002, good, "small2")]
    verdict = {r[0]: r for r in got(spark, rows)}
    assert verdict[3000][3] == ("base",) and not verdict[3000][4] and verdict[3001][3] == () and verdict[3002][4]


def test_very_long_text(spark):
    text = " ".join(str(i) for i in range(300_000)) + " " + " ".join(str(i) for i in range(1000, 2000))
    assert got(spark, [(1, text, "a")])[0][1] == tuple(counts(text).values())


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "x", "s", 3)], SCHEMA).withColumns({"_quality": F.lit("q"), "words": F.lit(1), "_host": F.array(F.lit(1)), "_docs": F.lit(2.5)})
    out = q.judge(df.drop("_quality"))
    assert out.columns == [*df.drop("_quality").columns, "_quality"] and out.first()["_host"] == [1]
    assert q.judge(df.filter("false"), ["doc_id"]).count() == 0
