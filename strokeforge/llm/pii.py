"""Format-preserving Feistel pseudonyms for personal data, in DataFrame and SQL functions only.

Values are found by pattern, validated (Luhn for card numbers, mod 97 for IBANs, calendar for
dates, ranges for the parts of addresses and numbers), and replaced by a keyed permutation of
their own format, so a value has the same pseudonym in every document, different values have
different ones, and a pseudonym validates as the value did. Three Feistel networks of ROUNDS
rounds, with SHA-256 of key, round and the other half as the round function:

- over characters (digits, capitals and small letters move within their class by modular
  addition): the middle digits of cards (the first stays, the check digit is set anew), the
  subscriber's digits of telephone numbers, the account part of IBANs (check digits set anew),
  the local part of e-mail addresses;
- over two 16-bit halves: IPv4 addresses;
- over numbers below a bound, as a pair of remainders, walked again while it is beyond the
  bound: dates (days from 1900 to 2099) and US social security numbers.

What is not valid stays as it is. With the key, restore() runs the networks backwards.

Defined results: a null text stays null with no values; an empty one stays empty; values that
repeat are replaced each time; rows that repeat are each returned; an empty table gives an
empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ROUNDS = 8
#: Where the key comes from if the caller gives none; a session without it gets a key for trials, which is no secret.
KEY_CONF, TRIAL_KEY = "spark.strokeforge.pii.key", "strokeforge"

#: kind -> pattern; a match is of the first kind whose pattern it is and whose rule it meets.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z.-])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z]|[.-][0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?|\([0-9]{3}\) ?[0-9]{3}[ .-]|[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-])[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[2-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
}
ANY = "|".join(f"(?:{p})" for p in [*KINDS.values()][:-1]) + "|(?:" + KINDS["date"] + ")"
DAYS = 73_049  # from 1900-01-01 to 2099-12-31


def q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sha(key: str, tag: str, rnd: str, half: str) -> str:
    return f"sha2(concat({q(key + '|' + tag + '|')}, {rnd}, '|', {half}), 256)"


def chars(x: str, key: str, tag: str, back: bool) -> str:
    """SQL: the Feistel network over the characters of x; an odd one is in the second half."""
    sign = "-" if back else "+"
    cls = lambda lo, hi, base, n: f"WHEN c BETWEEN '{lo}' AND '{hi}' THEN char({base} + pmod(ascii(c) - {base} {sign} cast(conv(substr(d, (i % 16) * 4 + 1, 4), 16, 10) AS INT), {n}))"
    move = f"CASE {cls('0', '9', 48, 10)} {cls('A', 'Z', 65, 26)} {cls('a', 'z', 97, 26)} ELSE c END"
    mix = lambda part, d: f"array_join(transform(split({part}, ''), (c, i) -> element_at(transform(array({d}), d -> {move}), 1)), '')"
    rnd = f"({ROUNDS - 1} - r)" if back else "r"
    halves = f"named_struct('a', substr({x}, 1, cast(length({x}) DIV 2 AS INT)), 'b', substr({x}, cast(length({x}) DIV 2 AS INT) + 1))"
    step = f"named_struct('a', {mix('s.b', sha(key, tag, rnd, 's.a'))}, 'b', s.a)" if back else f"named_struct('a', s.b, 'b', {mix('s.a', sha(key, tag, rnd, 's.b'))})"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {halves}, (s, r) -> {step}, s -> concat(s.a, s.b))"


def numbers(x: str, key: str, tag: str, m: int, n: int, back: bool, bound: int) -> str:
    """SQL: the network over x below bound <= m * n as (x mod m, x div m), rounds adding in turn mod m and mod n; cycle walking."""
    sign = "-" if back else "+"
    h = lambda half: f"cast(conv(substr({sha(key, tag, 'r', half)}, 1, 12), 16, 10) AS BIGINT)"
    step = f"IF(r % 2 = 0, named_struct('a', pmod(s.a {sign} {h('s.b')}, {m}L), 'b', s.b), named_struct('a', s.a, 'b', pmod(s.b {sign} {h('s.a')}, {n}L)))"
    order = f"reverse(sequence(0, {ROUNDS - 1}))" if back else f"sequence(0, {ROUNDS - 1})"
    once = f"aggregate({order}, named_struct('a', v % {m}L, 'b', v DIV {m}L), (s, r) -> {step}, s -> s.b * {m}L + s.a)"
    # m * n is so near the bound that one walk leaves it with a chance below 1 in 500; 24 in a row that do are an error.
    left = "cast(raise_error('the walk left the bound 25 times') AS BIGINT)"
    return f"aggregate(sequence(0, 24), cast({x} AS BIGINT), (v, w) -> IF(w > 0 AND v < {bound}L, v, {once}), v -> IF(v < {bound}L, v, {left}))"


def restored(digits: str, like: str) -> str:
    """SQL: like with its letters and digits replaced, in order, by the characters of digits."""
    return (
        f"aggregate(split({like}, ''), named_struct('n', 0, 'o', ''), (t, c) -> IF(c RLIKE '[0-9A-Za-z]', "
        f"named_struct('n', t.n + 1, 'o', concat(t.o, substr({digits}, t.n + 1, 1))), named_struct('n', t.n, 'o', concat(t.o, c))), t -> t.o)"
    )


def bind(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def luhn(digits: str, odd: int) -> str:
    """SQL: the Luhn sum of digits, doubling each second from the right, from the last if odd is 1."""
    return f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> IF((i + {odd}) % 2 = 0, cast(c AS INT), cast(c AS INT) * 2 - IF(cast(c AS INT) > 4, 9, 0))), 0, (t, e) -> t + e)"


def mod97(iban: str) -> str:
    moved = f"concat(substr({iban}, 5), substr({iban}, 1, 4))"
    return f"aggregate(split({moved}, ''), 0, (t, c) -> IF(c RLIKE '[0-9]', (t * 10 + cast(c AS INT)) % 97, (t * 100 + ascii(c) - 55) % 97))"


def pseudonym(m: str, kind: str, key: str, back: bool) -> str:
    """SQL: the pseudonym of match m of a kind, or null where m isn't valid."""
    plain = "regexp_replace({}, '[^0-9A-Za-z]', '')"
    if kind == "email":
        local = f"substring_index({m}, '@', 1)"
        return f"concat({bind(local, 'x', chars('x', key, kind, back))}, substr({m}, length({local}) + 1))"
    if kind == "card":
        made = bind(f"concat(substr(x, 1, 1), {chars('substr(x, 2, length(x) - 2)', key, kind, back)})", "y", f"concat(y, cast(pmod(10 - {luhn('y', 1)} % 10, 10) AS STRING))")
        return bind(plain.format(m), "x", f"IF(length(x) BETWEEN 13 AND 19 AND {luhn('x', 0)} % 10 = 0, {bind(made, 'z', restored('z', m))}, NULL)")
    if kind == "iban":
        body = f"concat(substr(x, 1, 2), '00', {chars('substr(x, 5)', key, kind, back)})"
        made = bind(body, "y", f"concat(substr(y, 1, 2), lpad(cast(98 - {mod97('y')} AS STRING), 2, '0'), substr(y, 5))")
        return bind(plain.format(m), "x", f"IF(length(x) BETWEEN 15 AND 34 AND {mod97('x')} = 1, {bind(made, 'z', restored('z', m))}, NULL)")
    if kind == "phone":
        # North American: after +1 or with brackets all ten digits move; else the first digits of area and exchange stay, which alone tell that it is a number. Others: the country code's first digits stay.
        us = f"{m} RLIKE '^(\\\\+1|[^+])'"
        ten = f"substr(x, length(x) - 9)"
        made = bind(chars(f"concat(substr({ten}, 2, 2), substr({ten}, 5))", key, kind, back), "y", f"concat(substr(x, 1, length(x) - 10), substr({ten}, 1, 1), substr(y, 1, 2), substr({ten}, 4, 1), substr(y, 3))")
        all_ten = f"concat(substr(x, 1, length(x) - 10), {chars(ten, key, kind, back)})"
        made = f"IF({m} RLIKE '^(\\\\+1|[(])', {all_ten}, {made})"
        world = f"concat(substr(x, 1, 3), {chars('substr(x, 4)', key, kind, back)})"
        return bind(plain.format(m), "x", f"IF({us}, {bind(made, 'z', restored('z', m))}, IF(length(x) BETWEEN 8 AND 15, {bind(world, 'z', restored('z', m))}, NULL))")
    if kind == "ip":
        number = "aggregate(transform(split(x, '[.]'), o -> cast(o AS BIGINT)), 0L, (t, o) -> t * 256 + o)"
        made = bind(numbers(number, key, kind, 65536, 65536, back, 1 << 32), "y", "concat_ws('.', y DIV 16777216, y DIV 65536 % 256, y DIV 256 % 256, y % 256)")
        return bind(m, "x", f"IF(forall(split(x, '[.]'), o -> cast(o AS INT) <= 255 AND (o = '0' OR o NOT LIKE '0%')), {made}, NULL)")
    if kind == "ssn":
        area, group, serial = (f"cast(substr({m}, {a}, {n}) AS BIGINT)" for a, n in ((1, 3), (5, 2), (8, 4)))
        rank = f"{area} - IF({area} > 666, 2, 1)"
        number = f"(({rank}) * 99 + {group} - 1) * 9999 + {serial} - 1"
        made = bind(numbers(number, key, kind, 29_815, 29_816, back, 898 * 99 * 9999), "y", "concat(lpad(cast(y DIV 989901 + IF(y DIV 989901 >= 665, 2, 1) AS STRING), 3, '0'), '-', lpad(cast(y DIV 9999 % 99 + 1 AS STRING), 2, '0'), '-', lpad(cast(y % 9999 + 1 AS STRING), 4, '0'))")
        return f"IF({area} NOT IN (0, 666) AND {area} < 900 AND {group} > 0 AND {serial} > 0, {made}, NULL)"
    form = f"CASE WHEN {m} RLIKE '^[0-9]{{4}}-' THEN 'yyyy-MM-dd' WHEN {m} RLIKE '^[0-9]{{4}}/' THEN 'yyyy/MM/dd' WHEN {m} LIKE '%/%' THEN 'MM/dd/yyyy' ELSE 'dd.MM.yyyy' END"
    parts = f"CASE WHEN {m} RLIKE '^[0-9]{{4}}' THEN array(substr({m}, 1, 4), substr({m}, 6, 2), substr({m}, 9, 2)) WHEN {m} LIKE '%/%' THEN array(substr({m}, 7), substr({m}, 1, 2), substr({m}, 4, 2)) ELSE array(substr({m}, 7), substr({m}, 4, 2), substr({m}, 1, 2)) END"
    day = f"datediff(try_cast(array_join({parts}, '-') AS DATE), DATE'1900-01-01')"
    made = f"date_format(date_add(DATE'1900-01-01', cast({numbers('x', key, kind, 271, 270, back, DAYS)} AS INT)), {form})"
    return bind(day, "x", f"IF(x BETWEEN 0 AND {DAYS - 1}, {made}, NULL)")


def replaced(docs: DataFrame, key: str | None = None, back: bool = False) -> DataFrame:
    """docs with text pseudonymised (back: restored) and _found, the (kind, value) pairs replaced."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, TRIAL_KEY)
    names = docs.columns
    rows = docs.select(F.struct(*[c for c in names if c != "text"]).alias("_row") if len(names) > 1 else F.lit(None).alias("_row"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("m", F.expr(f"IF(text RLIKE '[0-9@]', regexp_extract_all(text, {q(ANY)}, 0), array())"))
    case = "coalesce(" + ", ".join(f"IF(m RLIKE {q('^(?:' + p + ')$')}, {bind(pseudonym('m', k, key, back), 'v', f'IF(v IS NULL, NULL, named_struct({q("kind")}, {q(k)}, {q("value")}, m, {q("new")}, v))')}, NULL)" for k, p in KINDS.items()) + ")"
    rows = rows.withColumn("p", F.expr(f"IF(size(m) > 0, transform(m, m -> {case}), array())"))
    # The text between matches: as many pieces as matches, and one.
    rows = rows.withColumn("gap", F.expr(f"IF(size(m) > 0, split(text, {q(ANY)}, -1), array(text))"))
    joined = "concat(gap[0], array_join(zip_with(zip_with(m, p, (a, b) -> coalesce(b.new, a)), slice(gap, 2, size(m)), (a, b) -> concat(a, b)), ''))"
    rows = rows.withColumn("new_text", F.expr(f"IF(size(m) > 0, {joined}, text)"))
    rows = rows.withColumn("found", F.expr("transform(filter(p, x -> x IS NOT NULL), x -> named_struct('kind', x.kind, 'value', x.value, 'new', x.new))"))
    return rows.select(*[F.col("new_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in names], F.col("found").alias("_found"))


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    return replaced(docs, key)


def restore(docs: DataFrame, key: str | None = None) -> DataFrame:
    return replaced(docs, key, back=True)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text, and how many values of each kind were replaced, of every document."""
    out = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"coalesce(size(filter(_found, x -> x.kind = '{k}')), 0)").cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", "text", *counts, F.coalesce(F.size("_found"), F.lit(0)).cast("long").alias("n_replaced"))
