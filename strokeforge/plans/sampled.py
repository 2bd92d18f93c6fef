"""Queries over generated streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grammar
from ..operators import sampling
from . import fixtures as fx
from .core import LINES, TOKENS
from .registry import query

#: A prompt is the first tokens of an order's stream, fewer than it has.
_SIZE = "1 + doc_id % 3"
_U = "((('0x' || substr(md5(concat_ws(':', 7, p.doc_id, p.size, c.t)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE)"


@query(
    "m14_sample_step", f"WITH {LINES}, {TOKENS}, s AS (SELECT doc_id, list_transform(string_split(t, ','), lambda x: x::INT) AS t FROM lean), "
    "w AS (SELECT t[i] AS last, t[i + 1] AS t, count(*) AS w FROM s, unnest(range(1, len(t))) AS r(i) GROUP BY ALL), "
    f"p AS (SELECT doc_id, {_SIZE} AS size, t[{_SIZE}] AS last FROM s), "
    "c AS (SELECT p.doc_id, p.size, w.t, w.w, row_number() OVER o AS nth, sum(w.w) OVER (o ROWS UNBOUNDED PRECEDING) - w.w AS before FROM p JOIN w USING (last) "
    "WHERE CASE WHEN p.size % 2 = 0 THEN w.t >= 100 ELSE w.t < 100 END WINDOW o AS (PARTITION BY p.doc_id ORDER BY w.w DESC, w.t)), "
    "k AS (SELECT *, sum(w) OVER (PARTITION BY doc_id) AS total FROM c WHERE nth <= 20) "
    f"SELECT p.doc_id, arg_min(c.t, -ln({_U}) / c.w)::INT AS t FROM k c JOIN p USING (doc_id) WHERE c.nth = 1 OR c.before < 0.9 * c.total GROUP BY p.doc_id",
)
def m14_step(spark, d):
    """The next token of a prompt from every order."""
    streams = fx.streams(spark, d)
    rows = streams.withColumn("token_ids", F.expr(f"slice(token_ids, 1, cast({_SIZE} AS INT))")).withColumn("_state", F.expr(sampling.state("token_ids")))
    out = sampling.step(rows, sampling.weights(streams), "doc_id", 7, 20, 0.9)
    return out.select("doc_id", F.expr("element_at(token_ids, -1)").alias("t"))


@query("m14_generate", "SELECT c_custkey, true AS valid, true AS ends FROM customer")
def m14(spark, d):
    """A stream for every customer, drawn as orders' streams go on; whatever is drawn, the grammar holds."""
    prompts = fx.table(spark, d, "customer").select("c_custkey", F.array(F.lit(1)).alias("token_ids"))
    out = sampling.generate(prompts, fx.streams(spark, d), "c_custkey", 16, 7)
    return out.select("c_custkey", F.expr(f"({grammar.validated('token_ids')}).valid").alias("valid"), (F.expr("element_at(token_ids, -1)") == 2).alias("ends"))
