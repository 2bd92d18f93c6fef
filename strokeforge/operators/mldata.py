"""Data operators for training: collation, encodings, synthetic drawings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.sqlgen import uniform

MOST = 128


def length_filter(df: DataFrame, most: int = MOST) -> DataFrame:
    return df.filter(F.size("token_ids") <= most)


def collate(df: DataFrame, batch: str, most: int = MOST) -> DataFrame:
    """df with input_ids, target_ids (one ahead) and attention_mask, padded to the longest of the batch."""
    width = F.least(F.max(F.size("token_ids")).over(Window.partitionBy(batch)), F.lit(most))
    rows = df.withColumn("_w", width).withColumn("_n", F.least(F.size("token_ids"), "_w"))
    pad = "array_repeat(0, greatest(_w - _n, 0))"
    return rows.withColumns({
        "input_ids": F.expr(f"concat(slice(token_ids, 1, _n - 1), {pad})"), "target_ids": F.expr(f"concat(slice(token_ids, 2, _n - 1), {pad})"),
        "attention_mask": F.expr(f"concat(array_repeat(1, _n - 1), {pad})"),
    }).drop("_w", "_n")


def lookup(t: str) -> str:
    """SQL: level and centre of a coordinate id on the unit square; zeros for other ids."""
    g = lambda q: ids._by_level(t, lambda k: f"({q(k)} + 0.5D) / {2**k}D")
    x, y = g(lambda k: f"({t} - {ids.level_base(k)}) % {2**k}"), g(lambda k: f"floor(({t} - {ids.level_base(k)}) / {2**k})")
    return f"array(coalesce({ids.level_of(t)} / {ids.LEVEL}D, 0D), coalesce({x}, 0D), coalesce({y}, 0D))"


def positions(pos: str, d: int) -> str:
    """SQL: sines and cosines of a position, by turns."""
    angle = f"{pos} * exp(-cast(floor(i / 2) AS DOUBLE) * 2 * {math.log(10000.0) / d!r}D)"
    return f"transform(sequence(0, {d - 1}), i -> IF(i % 2 = 0, sin({angle}), cos({angle})))"


def spatial(nx: str, ny: str, d: int, version: int = 1) -> str:
    """SQL: unit vector of sines of x and cosines of y at growing frequencies."""
    half = d // 2
    power = f"floor(i / 2) * {8.0 / half if version >= 2 else 6.0 / half!r}D{' - 2' if version >= 2 else ''}"
    raw = f"transform(sequence(0, {2 * half - 1}), i -> IF(i % 2 = 0, sin({nx} * {2 * math.pi!r}D * power(2D, {power})), cos({ny} * {2 * math.pi!r}D * power(2D, {power}))))"
    return f"element_at(transform(array({raw}), e -> transform(e, v -> v / sqrt(aggregate(e, 0D, (a, z) -> a + z * z)))), 1)"


def cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (u, w) -> cast(u AS DOUBLE) * w), 0D, (s, v) -> s + v)"
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


def loss(rows: DataFrame, logits: str, target: str, pad: int = 0) -> DataFrame:
    """One row: n, mean cross entropy in nats and accuracy of rows of logits, those whose target is pad left out.

    Of equal greatest logits the first is the prediction.
    """
    top = f"array_max({logits})"
    spread = f"ln(aggregate({logits}, 0D, (a, v) -> a + exp(v - {top}))) + {top}"
    real = rows.filter(F.col(target) != pad)
    return real.agg(F.count("*").alias("n"), F.avg(F.expr(f"{spread} - {logits}[{target}]")).alias("loss"), F.avg(F.expr(f"IF(array_position({logits}, {top}) - 1 = {target}, 1D, 0D)")).alias("accuracy"))


def parameters(vocab: int, d_model: int, d_type: int, d_coord: int, d_ff: int, layers: int) -> int:
    """Estimated weights: embeddings of tokens, types and coordinates, their projection, layers, head."""
    embedding = vocab * d_model + 7 * d_type + 6 * d_coord + 6 + (d_model + d_type + d_coord) * d_model
    return embedding + layers * (4 * d_model**2 + 2 * d_model * d_ff + 2 * d_model) + vocab * d_model


def nucleus(probabilities: DataFrame, group: str, token: str, p: str, top_k: int, top_p: float) -> DataFrame:
    """The tokens that top-k and then top-p sampling leave in each group."""
    w = Window.partitionBy(group).orderBy(F.desc(p), token)
    first = probabilities.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_k)
    mass = first.withColumn("_p", F.col(p) / F.sum(p).over(Window.partitionBy(group)))
    return mass.withColumn("_c", F.sum("_p").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter(F.coalesce("_c", F.lit(0.0)) < top_p).drop("_r", "_c", "_p")


#: Kinds of synthetic drawings and their weights.
KINDS = (("circle", 0.15), ("rect", 0.15), ("ellipse", 0.10), ("line_path", 0.20), ("curve_path", 0.15), ("mixed_path", 0.15), ("multi", 0.10))


def synthetic_for(keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """sample_id, category, token_ids: one drawing for each row, drawn by hashes of its key; equal keys give equal drawings, a null key none."""
    u = lambda *k: uniform(f"concat_ws(':', 'draw', {seed}, sample_id, {', '.join(map(str, k))})")
    edge, cases = 0.0, []
    for name, w in KINDS:
        edge += w
        cases.append(f"WHEN r < {edge!r}D THEN '{name}'")
    at = lambda *k: ids.coord_id(f"{u(*k[:-1])} * 299", f"{u(*k[:-2], k[-1])} * 299")
    sc = lambda k: ids.scalar_id(f"{u(k)} * 100 + 5")
    circle, rect, oval = f"array(20, {at(1, 2)}, {sc(3)})", f"array(22, {at(1, 2)}, {sc(3)}, {sc(4)})", f"array(21, {at(1, 2)}, {sc(3)}, {sc(4)})"
    line, curve = f"array(11, {at('i', 0, 1)})", f"array(14, {at('i', 0, 1)}, {at('i', 2, 3)}, {at('i', 4, 5)})"
    path = lambda one: f"concat(array(10, {at(1, 2)}), flatten(transform(sequence(1, 3 + cast(floor({u(5)} * 5) AS INT)), i -> {one})))"
    body = f"CASE category WHEN 'circle' THEN {circle} WHEN 'rect' THEN {rect} WHEN 'ellipse' THEN {oval} WHEN 'line_path' THEN {path(line)} WHEN 'curve_path' THEN {path(curve)} WHEN 'mixed_path' THEN {path(f'IF(i % 2 = 0, {line}, {curve})')} ELSE concat({circle}, array(3), {rect}) END"
    rows = keys.select(F.col(key).alias("sample_id")).filter("sample_id IS NOT NULL").withColumn("r", F.expr(u(0)))
    rows = rows.withColumn("category", F.expr(f"CASE {' '.join(cases)} ELSE 'multi' END"))
    return rows.select("sample_id", "category", F.expr(f"concat(array(1), {body}, array(2))").alias("token_ids"))


def synthetic(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """sample_id, category, token_ids of n drawings, each from hashes of its own number: any split gives the same rows."""
    return synthetic_for(spark.range(n), "id", seed)
