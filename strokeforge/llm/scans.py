"""Running sums, maxima and exclusive-ors over rows in order, whatever share of them one group holds.

Rows are dealt into ranges of their order, so a hot group spreads over many ranges. A range is
folded by a window, and what came before it is carried in from one row a range: the number of
ranges is spark.sql.shuffle.partitions, a setting, and does not grow with the rows.

Defined results: group columns must not be null; order columns may be (null first); rows equal
in all order columns are in either order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_FOLDS = {"sum": F.sum, "max": F.max, "xor": F.bit_xor}


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _part, the range of order that a row is in; a stored table, so that no row changes its range when it is read again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def carried(parts: DataFrame, group: list[str], values: dict) -> DataFrame:
    """For every range but the first its _part, _group (the last group before it) and each value of that group so far: a row a range."""
    folded = parts.groupBy("_part", *group).agg(*[_FOLDS[f](c).alias(name) for name, (f, c) in values.items()])
    last = folded.groupBy("_part").agg(F.max(F.struct(F.struct(*group).alias("group"), F.struct(*values).alias("values"))).alias("last"))
    so_far = Window.partitionBy("last.group").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = last.select("_part", F.col("last.group").alias("_group"), *[_FOLDS[f](F.col(f"last.values.{name}")).over(so_far).alias(f"_{name}") for name, (f, _) in values.items()])
    return total.withColumn("_part", F.lead("_part").over(Window.orderBy("_part"))).filter("_part IS NOT NULL")


def running(parts: DataFrame, group: list[str], order: list[str], values: dict, strict: tuple = ()) -> DataFrame:
    """parts (of ranged() by group and order) with, for each name of values, the fold of a column over the group's rows so far.

    values: name -> (sum, max or xor; column). For names in strict the row itself does not count.
    """
    by = Window.partitionBy("_part", *group).orderBy(*order)
    inner = {name: _FOLDS[f](c).over(by.rowsBetween(Window.unboundedPreceding, -1 if name in strict else Window.currentRow)) for name, (f, c) in values.items()}
    joined = parts.withColumns(inner).join(F.broadcast(carried(parts, group, values)), "_part", "left")
    same = F.col("_group") == F.struct(*group)
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "xor": lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0))), "max": F.greatest}
    out = {name: join[f](F.col(name), F.when(same, F.col(f"_{name}"))) for name, (f, _) in values.items()}
    return joined.withColumns(out).drop("_group", *[f"_{name}" for name in values])
