"""Paths of any length as rows of pieces, so that neither a row nor a task holds a whole one.

A piece is some commands of a path in their order, and begins with a command. Commands are
absolute (M, L, C, Q, Z; another letter is an error), so what a piece says does not depend on
the pieces before it. For the grammar it is a stream of its own: a command may follow only a
whole group, and after any of these leads to the same state, so a stream is valid exactly if
every piece of it is between its own brackets. Decoded pieces joined by blanks are the decoded path.

Defined results: commands with equal order are in either order; a null key is a key; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, path, tokens
from ..sources.shared import materialize
from . import codec

#: Commands of a piece.
PIECE = 256


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with i, the place of each among those of its key, from 0: the rows of lesser ranges, and those within its own."""
    parted = materialize(rows.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "path-ranges")
    sizes = parted.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count("*").alias("n"))  # a row for each key of a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("_part", key).orderBy(order)) - 1
    ranked = parted.withColumn("_within", within).join(F.broadcast(before), (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    return ranked.withColumn("i", F.col("_before") + F.col("_within")).drop("_part", "_of", "_key", "_before", "_within")


def pieces(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, part, first (the place of its first command) and d of each piece, of rows of numbered() with the text of one command each."""
    spark = rows.sparkSession
    # Dealt by number: few bytes are much work, and what is dealt by size would come to few tasks.
    dealt = rows.withColumn("part", F.floor(F.col("i") / PIECE)).repartition(4 * spark.sparkContext.defaultParallelism, key, "part")
    held = dealt.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct("i", F.expr(text).alias("text")))).alias("c"))
    return held.select(key, "part", F.expr("c[0].i").alias("first"), F.expr("array_join(c.text, ' ')").alias("d"))


def encoded(rows: DataFrame) -> DataFrame:
    """rows, which have d, with body, the lean tokens of each piece, between no brackets."""
    refused = F.when(F.col("d").rlike("[mlHhVvcSsqTtAaz]"), F.raise_error(F.lit("pieces of long paths have absolute commands M, L, C, Q and Z only")).cast("string"))
    return rows.withColumn("d", F.coalesce(refused, "d")).withColumn("body", F.expr(tokens.lean(path.parsed("d"))))


def decoded(rows: DataFrame) -> DataFrame:
    """rows, which have body, with valid, and d_decoded, the path text that each piece decodes to."""
    streams = rows.withColumns({"token_ids": F.expr("concat(array(1), body, array(2))"), "tokenizer_version": F.lit(ids.TOKENIZER_VERSION)})
    back = codec.detokenize(streams, measure=False)
    return back.withColumn("d_decoded", F.expr("regexp_extract(svg, ' d=\"([^\"]*)\"', 1)")).select(*rows.columns, "valid", "d_decoded")


def started(rows: DataFrame, key: str) -> DataFrame:
    """rows, which have key, part and body, with start, how many tokens the path has before each piece; BOS, the first, is one of them.

    The bodies stay where they are; only their numbers of tokens are put in order, a row a piece. rows are read twice.
    """
    sizes = rows.select(F.col(key).alias("_key"), F.col("part").alias("_of"), F.size("body").alias("_n"))
    before = sizes.select("_key", "_of", (1 + F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"))
    return rows.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_of"))).drop("_key", "_of")
