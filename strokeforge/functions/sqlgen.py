"""Small helpers that write Spark SQL expressions as text.

Row-local logic is built as SQL text because lambdas nest by name there; everything stays in
the JVM and needs no shuffle. Lambda variables are named in one to four letters, so arguments
that are columns should have longer names, or be a lambda variable of the caller's that the
function does not bind itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(bindings: dict[str, str], body: str, kind: str = "double") -> str:
    """body, of SQL type kind, with names bound in order; each value is computed once and may use the names before it.

    A fold over one value: its type is that of its start, so the analyser need not descend into
    the body again for each level above it.
    """
    for name, value in reversed(bindings.items()):
        body = f"aggregate(array({value}), cast(NULL AS {kind}), (_, {name}) -> {body})"
    return body


def scan(items: str, name: str, start: str, state: str, out: str, step: Callable[[str], str], last: Callable[[str], str] | None = None) -> str:
    """What step gives for each of items, in order, as one array; the state goes from one to the next.

    step and last take the name of the state (of SQL type state) and see the item as name; step
    gives named_struct('st', the next state, 'out', an array of SQL type out), last the end's array.
    A fold copies what it has built with each step, so items are taken in blocks of about the
    square root of their number: what is built is then small within a block, and a block is
    copied as one. Names of lambda variables here have two letters and end in f.
    """
    none, nones = f"cast(array() AS array<{out}>)", f"cast(array() AS array<array<{out}>>)"
    begin = lambda st: f"named_struct('now', named_struct('st', {st}, 'out', {none}), 'all', {nones})"
    # What a step gives is put away by the next one: it would be computed twice otherwise.
    away = lambda f: f"concat({f}.all, array({f}.now.out))"
    block = f"aggregate(bf, {begin('af.now.st')}, (ef, {name}) -> named_struct('now', {step('ef.now.st')}, 'all', {away('ef')}), ef -> named_struct('st', ef.now.st, 'out', flatten({away('ef')})))"
    blocks = f"element_at(transform(array({items}), xf -> transform(sequence(0, greatest(size(xf) - 1, 0), greatest(8, cast(sqrt(size(xf)) AS INT))), kf -> slice(xf, kf + 1, greatest(8, cast(sqrt(size(xf)) AS INT))))), 1)"
    ends = f"flatten({away('af')})" if last is None else f"concat(flatten({away('af')}), {last('af.now.st')})"
    return f"aggregate({blocks}, {begin(start)}, (af, bf) -> named_struct('now', {block}, 'all', {away('af')}), af -> {ends})"


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(sql: str) -> Column:
    return F.expr(sql)


def uniform(key: str) -> str:
    """SQL: a number between 0 and 1 from the hash of a text."""
    return f"((cast(conv(substr(md5({key}), 1, 13), 16, 10) AS DOUBLE) + 0.5D) / 4503599627370496D)"


def doubles(array: str) -> str:
    return f"transform({array}, v -> cast(v AS DOUBLE))"


def trimmed(number: str, places: int) -> str:
    """A double rounded to places decimals (ties to even), without trailing zeros: '11.7', '290', '-0'."""
    return f"regexp_replace(cast(cast(bround({number}, {places}) AS DECIMAL(18,{places})) AS STRING), '[.]?0+$', '')" if places else f"cast(cast({number} AS BIGINT) AS STRING)"
