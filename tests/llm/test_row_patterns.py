import hashlib
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strokeforge.llm import row_patterns as rp

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
T0 = datetime(2024, 1, 1)


def brute(rows):
    """The matches of rows (click_id, ts, arrived_at, client_id, kind, value, props), by Python's own regular expressions."""
    clients = {}
    for r in set(rows):
        if r[3] is not None and r[1] is not None:
            v = r[5]
            cents = None if v is None or v != v or abs(v) == float("inf") else int((100 * v + 0.5) // 1)
            k = 0 if r[4] in (None, "error") else 2 if r[4] == "view" else 1
            clients.setdefault(r[3], []).append((r[1], r[0], k, -(1 << 70) if cents is None else cents, cents))
    out = []
    for client, seq in clients.items():
        seq.sort()
        at, n = 0, 0
        while at < len(seq):
            a = seq[at][4]
            text = ""
            for i in range(at + 1, len(seq)):
                (t0, *_, c0), (t1, _, k, _, c1) = seq[i - 1], seq[i]
                near = c0 is not None and c1 is not None and t1 <= t0 + timedelta(minutes=15)
                x = "d" if near and k and c1 < c0 else "u" if near and k and c1 > c0 else "n"
                y = near and k == 2 and a is not None and c1 >= a
                if x == "n" and not y:
                    break
                text += (x.upper() if y else x) if x != "n" else "E"
            m = re.match("([duDU]*)([DUE])([dD]*)", text) if a is not None else None
            if m is None:
                at += 1
                continue
            n += 1
            last = at + m.end()
            labels = "A" + m[1].upper() + "P" + m[3].upper()
            out.append((client, n, seq[at][1], seq[last][1], last - at + 1, sum(r[4] for r in seq[at : last + 1]), labels))
            at = last
    return sorted(out)


def rows_of(seed, n, clients, gap, values):
    r = random.Random(seed)
    t, out = T0, []
    for i in range(n):
        t += timedelta(seconds=r.random() * gap)
        row = (i, t if r.random() > 0.01 else None, t, r.choice(clients), r.choice(["view", "view", "click", "purchase", "view", "error", None] if gap > 100 else ["view", "click", "click"]), r.choice(values), r.choice([None, "{}"]))
        out += [row] * (2 if r.random() < 0.05 else 1)
    r.shuffle(out)
    return out


def got(spark, rows, limit=rp.LIMIT):
    return sorted(tuple(r) for r in rp.match_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), limit).collect())


@pytest.mark.parametrize("limit", [rp.LIMIT, 4])
def test_equals_backtracking(spark, limit):
    rows = rows_of(1, 900, [1, 1, 1, 2, 3, None], 400, [None, 1.0, 1.5, 2.0, 2.25, 3.0, -1.0, float("nan"), float("inf")])
    rows += rows_of(2, 500, [9], 20, [float(x) for x in range(12)])
    want = brute(rows)
    assert len(want) > 60 and got(spark, rows, limit) == want


def test_long_segments_are_matched_by_running_maxima(spark):
    r = random.Random(3)
    rows = [(i, T0 + timedelta(seconds=i), T0, 5, "view" if r.random() < 0.3 else "click", 1000 - i * 0.1 + r.random() * 30, None) for i in range(3000)]
    rows += [(9000 + i, T0 + timedelta(seconds=i), T0, 6, "view", 5.0, None) for i in range(700)]
    want = brute(rows)
    assert max(x[4] for x in want) > 100 and got(spark, rows) == want


def test_a_segment_of_one_client_is_spread(spark):
    n = 120_000
    rows = spark.range(n).selectExpr(
        "id AS click_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "timestamp_ntz '2024-01-01' AS arrived_at", "1L AS client_id",
        "if(pmod(xxhash64(id), 3) = 0, 'view', 'click') AS kind", "double(pmod(xxhash64(id, 1), 100000)) / 100 AS value", "'' AS props",
    )
    out = rp.match_rows(rows).collect()
    assert sum(r["n_rows"] - 1 for r in out) > n // 2
    assert all(len(r["labels"]) == r["n_rows"] for r in out) and [r["match_no"] for r in sorted(out, key=lambda r: r["first_id"])] == list(range(1, len(out) + 1))


def test_edges(spark):
    view = lambda i, s, v, kind="view", c=1: (i, T0 + timedelta(seconds=s), T0, c, kind, v, None)
    assert got(spark, []) == []
    # Exactly fifteen minutes is near enough, a microsecond more is not.
    assert got(spark, [view(1, 0, 1.0), view(2, 900, 2.0)]) == [(1, 1, 1, 2, 2, 300, "AP")]
    assert got(spark, [view(1, 0, 1.0), view(2, 900.000001, 2.0)]) == []
    assert got(spark, [view(1, 0, None), view(2, 1, 2.0), view(3, 2, 2.0)]) == [(1, 1, 2, 3, 2, 400, "AP")]
    # A match's last row may be the next one's first; ties of time go by id; equal rows count once.
    rows = [view(1, 0, 1.0), view(2, 0, 2.0), view(3, 5, 1.0), view(4, 5, 3.0)]
    assert got(spark, rows + rows) == [(1, 1, 1, 4, 4, 700, "AUDP")]
    assert got(spark, [(1, None, T0, 1, "view", 1.0, None), (2, T0, T0, None, "view", 1.0, None)]) == []


def test_other_columns_only_tell_rows_apart(spark):
    df = spark.createDataFrame([(1, T0, T0, 1, "click", 1.0, "a"), (2, T0, T0, 1, "view", 2.0, "b")], SCHEMA)
    df = df.withColumns({"client": F.lit("x"), "_part": F.lit(None).cast("int"), "no": F.array(F.lit(1)), "cents": F.map_from_arrays(F.array(F.lit(1)), F.array(F.lit(2)))})
    assert [tuple(r) for r in rp.match_rows(df).collect()] == [(1, 1, 1, 2, 2, 300, "AP")]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/clicks.parquet").select("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props").collect()]
    want = [(*x[:6], hashlib.sha256(x[6].encode()).hexdigest()) for x in brute(rows)]
    assert sorted(tuple(r) for r in rp.op11_row_patterns(spark, "/root/testdata/sf0.001").collect()) == want
