import hashlib
import random
import re
from datetime import datetime, timedelta

import pytest

from strokeforge.llm import pii

SCHEMA = "doc_id long, text string, m string, p int, gap string, found int, new_text string"


def luhn_ok(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


VALUES = {
    "email": ["bosbt.42@mail8.example.com", "A_b+c@x.org", "a@b.co"],
    "card": ["4041894974608795", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"],
    "phone": ["+1 (988) 555-2485", "212-555-0199", "(415) 555-2671", "+44 20 7946 0958"],
    "ip": ["42.144.35.254", "0.0.0.0", "255.255.255.255"],
    "ssn": ["078-05-1120", "899-99-9999", "667-01-0001"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "date": ["1999-12-31", "2000/02/29", "02/28/1990", "31.12.2001"],
}
KEPT = ["4041894974608796", "300.1.2.3", "000-12-3456", "666-12-3456", "2001-02-29", "13/13/2000", "version 1.2.3", "12345", "no@", "DE88370400440532013000", "1.2.3.4.5", "x4041894974608795"]


def run(spark, texts, **how):
    rows = spark.createDataFrame([(i, t, "c", 1, "g", 2, "n") for i, t in enumerate(texts)], SCHEMA)
    out = (pii.restore if how.pop("back", False) else pii.pseudonymise)(rows, **how)
    assert out.columns == [*rows.columns, "_found"]
    return {r.doc_id: r for r in out.collect()}


def test_values_keep_their_format_and_come_back(spark):
    flat = [(k, v) for k, vs in VALUES.items() for v in vs]
    out = run(spark, [v for _, v in flat])
    for i, (k, v) in enumerate(flat):
        new = out[i].text
        assert new != v and [x.kind for x in out[i]._found] == [k], (k, v, new)
        assert len(new) == len(v) if k != "ip" else True
        if k != "ip":
            assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v)))
        if k == "card":
            assert luhn_ok(new) and new[0] == v[0]
        if k == "iban":
            assert iban_ok(new)
    back = run(spark, [out[i].text for i in range(len(flat))], back=True)
    assert [back[i].text for i in range(len(flat))] == [v for _, v in flat]


def test_in_text(spark):
    r = random.Random(1)
    texts, found = [], []
    for _ in range(60):
        picked = [r.choice(VALUES[r.choice(list(VALUES))]) for _ in range(r.randrange(4))]
        texts.append("Héllo " + " and, ".join(f"<{v}>" if r.random() < 0.3 else v for v in picked) + r.choice(["", ".", " end\n"]))
        found.append(picked)
    out = run(spark, [*texts, None, "", *KEPT, "4041894974608795", "4041894974608795 " * 3000])
    seen = {}
    for i, picked in enumerate(found):
        assert [x.value for x in out[i]._found] == picked, texts[i]
        for x in out[i]._found:
            assert seen.setdefault(x.value, x.new) == x.new
        t = texts[i]
        for x in out[i]._found:
            t = t.replace(x.value, x.new, 1) if x.value != x.new else t
        assert out[i].text == t
    assert len(set(seen.values())) == len(seen)
    n = len(texts)
    assert out[n].text is None and out[n + 1].text == ""
    assert [out[n + 2 + i].text for i in range(len(KEPT))] == KEPT
    one = out[n + 2 + len(KEPT)].text
    assert one == seen.get("4041894974608795", one) and out[n + 3 + len(KEPT)].text == (one + " ") * 3000


def test_numbers_are_permuted(spark):
    days = [f"{y}-{m:02}-{d:02}" for y in (1900, 2099) for m in range(1, 13) for d in range(1, 29)]
    out = run(spark, days)
    new = {r.text for r in out.values()}
    assert len(new) == len(days) and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", x) for x in new)
    other = run(spark, days[:5], key="another")
    assert all(other[i].text != out[i].text for i in range(5))


@pytest.mark.parametrize("texts", [[]])
def test_empty(spark, texts):
    assert run(spark, texts) == {}


def test_query(spark):
    rows = pii.op5_pii(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.n_replaced == sum(r[f"n_{k}"] for k in pii.KINDS) and (r.n_replaced > 0) == (r.text != docs[r.doc_id])


def test_phones_of_explicit_form_may_start_with_any_digit(spark):
    texts = ["+1 (017) 555-7713", "+1 (132) 555-1352", "+1 (171) 055-2028", "(099) 155-0123", "+12025550123", "+10005550123", "+1 202 555 0123", "+1-202-555-0123", "+1(202)5550123"]
    kept = ["117-555-7713", "217-155-7713", "12025550123"]
    out = run(spark, texts + kept)
    for i, t in enumerate(texts):
        assert [(x.kind, x.value) for x in out[i]._found] == [("phone", t)] and out[i].text != t
        assert re.sub("[0-9]", "0", out[i].text) == re.sub("[0-9]", "0", t) and out[i].text.startswith("+1") == t.startswith("+1")
    assert [out[len(texts) + i].text for i in range(len(kept))] == kept
    back = run(spark, [out[i].text for i in range(len(texts))], back=True)
    assert [back[i].text for i in range(len(texts))] == texts
    many = run(spark, [f"+1 ({i:03}) 555-0000" for i in range(300)])
    assert len({r.text for r in many.values()}) == 300 and len({r.text[4] for r in many.values()}) == 10


def network(x, key, tag):
    """The character network: halves change places, and the one that moves is shifted by digits of a digest of the other."""
    a, b = x[: len(x) // 2], x[len(x) // 2 :]
    for r in range(8):
        d = hashlib.sha256(f"{key}|{tag}|{r}|{b}".encode()).hexdigest()
        moved = ""
        for i, c in enumerate(a):
            lo, n = (48, 10) if c.isdigit() else (65, 26) if c.isupper() else (97, 26) if c.islower() else (None, 1)
            at = i % 16 * 4
            moved += c if lo is None else chr(lo + (ord(c) - lo + int(d[at : at + 4], 16)) % n)
        a, b = b, moved
    return a + b


def walk(v, key, tag, m, n, bound):
    """The network over pairs of remainders, again while it is beyond the bound."""
    while True:
        a, b = v % m, v // m
        for r in range(8):
            h = lambda half: int(hashlib.sha256(f"{key}|{tag}|{r}|{half}".encode()).hexdigest()[:12], 16)  # noqa: B023, E731
            a, b = ((a + h(b)) % m, b) if r % 2 == 0 else (a, (b + h(a)) % n)
        v = b * m + a
        if v < bound:
            return v


def laid(chars, like):
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in like)


def brute(kind, v, key):
    x = "".join(c for c in v if c.isalnum())
    if kind == "email":
        local, _, rest = v.partition("@")
        return network(local, key, kind) + "@" + rest
    if kind == "card":
        y = x[0] + network(x[1:-1], key, kind)
        return laid(next(y + str(c) for c in range(10) if luhn_ok(y + str(c))), v)
    if kind == "iban":
        account = network(x[4:], key, kind)
        return laid(next(f"{x[:2]}{c:02}{account}" for c in range(2, 99) if iban_ok(f"{x[:2]}{c:02}{account}")), v)
    if kind == "phone":
        head, ten = x[:-10], x[-10:]
        if v[0] == "+" and not v.startswith("+1"):
            return laid(x[:3] + network(x[3:], key, kind), v)
        if v[0] in "+(":
            return laid(head + network(ten, key, kind), v)
        y = network(ten[1:3] + ten[4:], key, kind)
        return laid(head + ten[0] + y[:2] + ten[3] + y[2:], v)
    if kind == "ip":
        y = walk(int.from_bytes(map(int, v.split(".")), "big"), key, kind, 65536, 65536, 1 << 32)
        return ".".join(map(str, y.to_bytes(4, "big")))
    if kind == "ssn":
        area, group, serial = map(int, v.split("-"))
        y = walk((area - (2 if area > 666 else 1)) * 99 * 9999 + (group - 1) * 9999 + serial - 1, key, kind, 29_815, 29_816, 898 * 99 * 9999)
        area, rest = divmod(y, 99 * 9999)
        return f"{area + (2 if area >= 665 else 1):03}-{rest // 9999 + 1:02}-{rest % 9999 + 1:04}"
    form = "%Y-%m-%d" if v[4] == "-" else "%Y/%m/%d" if v[4] == "/" else "%m/%d/%Y" if "/" in v else "%d.%m.%Y"
    start = datetime(1900, 1, 1)
    return (start + timedelta(walk((datetime.strptime(v, form) - start).days, key, kind, 271, 270, 73_049))).strftime(form)


def test_pseudonyms_against_an_independent_network(spark):
    flat = [(k, v) for k, vs in VALUES.items() for v in vs]
    for key in (pii.TRIAL_KEY, "another's key"):
        out = run(spark, [v for _, v in flat], key=key)
        assert [out[i].text for i in range(len(flat))] == [brute(k, v, key) for k, v in flat]


def test_key_of_the_session(spark):
    text = VALUES["card"]
    trial = {i: r.text for i, r in run(spark, text).items()}
    spark.conf.set(pii.KEY_CONF, "of the session")
    try:
        assert {i: r.text for i, r in run(spark, text).items()} == {i: r.text for i, r in run(spark, text, key="of the session").items()} != trial
    finally:
        spark.conf.unset(pii.KEY_CONF)


def test_empty_table(spark):
    assert run(spark, []) == {}
