"""Embeddings of token streams: first weights that know the format's geometry, and the forward pass.

initial() makes a row of weights for each id, by Spark: every number comes from a hash of its own
place, so any split, engine or rerun gives the same. Ids of one meaning lie around one centre,
ordered ids on a ramp, coordinates on a multi-scale encoding of their cell.

forward() looks ids up, projects and normalises them with numpy, in batches. All that comes before
positions depends on the id alone, so it is worked out once for each distinct id of a batch. The
weights are sent to the executors; their size depends on the vocabulary and not on the data, and is checked.

Defined results: ids outside the vocabulary count as the nearest id, null ids as padding; a null
stream gives null, an empty one an empty list.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import ids
from ..functions.sqlgen import uniform
from . import manifest, mldata

#: Ids of one meaning (first, last) and the number of their centre.
GROUPS = ((10, 10, 0), (11, 13, 1), (14, 15, 2), (16, 16, 3), (17, 17, 4), (20, 21, 5), (22, 23, 6), (60, 61, 7), (62, 63, 8), (64, 70, 9), (30, 33, 10), (40, 55, 12))
#: Ordered ids (first, last) and the number of the direction in which they go.
RAMPS = ((30, 33, 11), (40, 55, 13))
#: Ids that are a centre and a common base, those of them with noise, and others with noise.
BASED, BASED_NOISY, NOISY = (10, 17), (12, 13, 15), ((20, 23), (60, 70))
CENTRES, CLASSES = 14, 7
NOISE, BASE, CENTRE, STEP, FADE, MARK = 0.02, 0.1, 0.3, 0.5, 0.8, 0.1
MOST_BYTES = 256 << 20
#: Bytes of embeddings that a task makes at a time.
SLICE = 16 << 20


def normal(key: str) -> str:
    """SQL: a standard normal number from the hash of a text (Box and Muller)."""
    return f"(sqrt(-2D * ln({uniform(f'concat({key}, ' + repr(':a') + ')')})) * cos({2 * math.pi!r}D * {uniform(f'concat({key}, ' + repr(':b') + ')')}))"


def _unit(v: str, scale: str) -> str:
    return f"transform({v}, x -> x / greatest(sqrt(aggregate({v}, 0D, (a, z) -> a + z * z)), 1e-8D) * {scale})"


def initial(spark: SparkSession, d_model: int, version: int = 1, seed: int = 42) -> DataFrame:
    """token_id, weight (d_model doubles, an even number) of every id; version 2 makes all norms one, but for padding's."""
    last = f"sequence(0, {d_model - 1})"
    centres = spark.range(CENTRES).select(F.col("id").alias("k"), F.expr(f"transform({last}, j -> {normal(f'concat_ws({chr(39)}:{chr(39)}, {chr(39)}centre{chr(39)}, {seed} + 7 * id, j)')})").alias("v"))
    centres = centres.select("k", F.expr(_unit("v", f"{CENTRE}D")).alias("v"))
    case = lambda rows: "CASE " + " ".join(f"WHEN token_id BETWEEN {a} AND {b} THEN {v}" for a, b, v in rows) + " END"
    ramp = case([(a, b, f"{STEP}D * (token_id - {a}) / {b - a}D") for a, b, _ in RAMPS])
    noise = f"CASE WHEN token_id IN {BASED_NOISY} OR " + " OR ".join(f"token_id BETWEEN {a} AND {b}" for a, b in NOISY) + f" THEN {NOISE}D ELSE 0D END"
    rows = manifest.vocabulary(spark).select("token_id", "level", "qx", "qy").withColumns({"k": F.expr(case(GROUPS)).cast("long"), "m": F.expr(case(RAMPS)).cast("long"), "ramp": F.expr(ramp), "noise": F.expr(noise)})
    # Fourteen rows, whatever the model.
    rows = rows.join(F.broadcast(centres.toDF("k", "centre")), "k", "left").join(F.broadcast(centres.toDF("m", "way")), "m", "left")
    at = lambda what: f"concat_ws(':', '{what}', {seed}, token_id, j)"
    base = f"IF(token_id BETWEEN {BASED[0]} AND {BASED[1]}, {BASE}D * {normal(f'concat_ws({chr(39)}:{chr(39)}, {chr(39)}base{chr(39)}, {seed}, j)')}, 0D)"
    grouped = f"transform({last}, j -> centre[j] + {base} + coalesce(way[j] * ramp, 0D) + IF(noise > 0, noise * {normal(at('noise'))}, 0D))"
    cell = mldata.spatial("((qx + 0.5D) / power(2D, level))", "((qy + 0.5D) / power(2D, level))", d_model, version)
    fade, mark = ("1D", "0D") if version >= 2 else (f"power({FADE}D, level)", f"IF(j = least(level, {d_model - 1}), {MARK}D, 0D)")
    coordinate = f"element_at(transform(array({cell}), e -> transform({last}, j -> e[j] * {fade} + {mark} + {NOISE / 2!r}D * {normal(at('noise'))})), 1)"
    other = f"transform({last}, j -> (2D * {uniform(at('other'))} - 1D) * {math.sqrt(6 / (ids.VOCAB + d_model))!r}D)"
    rows = rows.select("token_id", F.expr(f"CASE WHEN token_id = 0 THEN transform({last}, j -> 0D) WHEN centre IS NOT NULL THEN {grouped} WHEN level IS NOT NULL THEN {coordinate} ELSE {other} END").alias("weight"))
    return rows.select("token_id", F.expr(_unit("weight", "1D")).alias("weight")) if version >= 2 else rows


@dataclass
class Model:
    """Weights of the forward pass; rows are outputs, as in a linear layer."""

    token: np.ndarray
    kind: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    w: np.ndarray
    b: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values())


def hashed(name: str, shape: tuple[int, ...], bound: float) -> np.ndarray:
    """Numbers between -bound and bound, each from the hash of its name and place."""
    u = [(int(hashlib.md5(f"{name}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(math.prod(shape))]
    return (2 * np.array(u).reshape(shape) - 1) * bound


def model(weights: DataFrame, d_type: int, d_coord: int, seed: int = 42) -> Model:
    """A model over first weights, with other layers from hashes; refused if larger than MOST_BYTES."""
    d = F.size("weight")
    n, d_model = weights.agg(F.max("token_id") + 1, F.max(d)).first()
    wide = d_model + d_type + d_coord
    if 8 * (n * d_model + wide * d_model) > MOST_BYTES:
        raise EngineError("PAYLOAD_TOO_LARGE", f"a model exceeds {MOST_BYTES} bytes", limit=MOST_BYTES)
    token = np.zeros((n, d_model))
    for r in weights.toLocalIterator():  # a row for each id of the vocabulary
        token[r["token_id"]] = r["weight"]
    layer = lambda name, out, n_in: (hashed(f"{name}.w:{seed}", (out, n_in), n_in**-0.5), hashed(f"{name}.b:{seed}", (out,), n_in**-0.5))
    return Model(token, hashed(f"kind:{seed}", (CLASSES, d_type), 1.0), *layer("first", d_coord, 3), *layer("second", d_coord, d_coord), *layer("projection", d_model, wide))


def features(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes (n,) of ids, and level and centre (n, 3) of coordinates, zeros for others."""
    kind = np.full(len(t), 6)
    for first, last, k in ((0, 9, 0), (10, 19, 1), (20, 29, 2), (30, 33, 3), (40, 55, 4), (60, 79, 5)):  # as ids.embedding_class()
        kind[(t >= first) & (t <= last)] = k
    cell, out = t >= ids.BASE, np.zeros((len(t), 3))
    bases = np.array([ids.level_base(k) for k in range(ids.LEVEL + 1)])
    level = np.searchsorted(bases, t[cell], "right") - 1
    place, grid = t[cell] - bases[level], 1 << level
    out[cell] = np.stack([level / max(ids.LEVEL, 1), (place % grid + 0.5) / grid, (place // grid + 0.5) / grid], 1)
    return kind, out


def projected(m: Model, t: np.ndarray) -> np.ndarray:
    """(n, d_model): ids with their class and place, projected."""
    kind, place = features(t)
    hidden = place @ m.w1.T + m.b1
    hidden = 0.5 * hidden * (1 + np.vectorize(math.erf, otypes=[float])(hidden / math.sqrt(2)))
    coord = (hidden @ m.w2.T + m.b2) * (t >= ids.BASE)[:, None]
    return np.concatenate([m.token[t], m.kind[kind], coord], 1) @ m.w.T + m.b


def waves(pos: np.ndarray, d: int) -> np.ndarray:
    angle = pos[:, None] * np.exp(np.arange(0, d, 2) * (-math.log(10000.0) / d))
    out = np.empty((len(pos), d))
    out[:, 0::2], out[:, 1::2] = np.sin(angle), np.cos(angle[:, : d // 2])
    return out


def normalised(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(1, keepdims=True) + eps)


def forward(df: DataFrame, m: Model, tokens: str = "token_ids", output: str = "embedding") -> DataFrame:
    """df with a vector for each token: projected, with its position's waves, normalised."""
    if m.nbytes > MOST_BYTES:
        raise EngineError("PAYLOAD_TOO_LARGE", f"a model exceeds {MOST_BYTES} bytes", limit=MOST_BYTES)
    shared, at, d = df.sparkSession.sparkContext.broadcast(m), df.columns.index(tokens), m.token.shape[1]

    def embedded(streams: pa.Array) -> pa.Array:
        sizes = np.array([len(s) if s.is_valid else 0 for s in streams], np.int64)
        flat = streams.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        seen, which = np.unique(np.clip(flat, 0, len(shared.value.token) - 1), return_inverse=True)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = normalised(projected(shared.value, seen)[which] + waves(pos, d)) if len(flat) else np.empty((0, d))
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) * d + 1, d, dtype=np.int32)), pa.array(out.reshape(-1)))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), vectors, mask=streams.is_null())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(s) if s.is_valid else 0 for s in batch.column(at)])
            first = 0
            while first < len(batch):  # as many streams as make SLICE bytes, one at least
                before = int(sizes[first - 1]) if first else 0
                end = max(first + 1, int(np.searchsorted(sizes, before + SLICE // (8 * d), "right")))
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, embedded(part.column(at))], names=[*batch.schema.names, output])
                first = end

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, `{output}` array<array<double>>")
