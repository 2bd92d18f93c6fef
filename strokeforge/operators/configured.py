"""The codec with a configuration for each row: canvas, deepest level, vocabulary and merges.

Configurations are manifests, a table (vocab_id, manifest JSON) that a row's vocab_id refers to.
They are few and small, which load() checks, so they are joined by broadcast and their merges go
to the tasks that encode; documents are read once, whatever the number of configurations, and
nothing is shuffled.

Defined results: a null vocab_id stands for the default one; a vocab_id without a manifest, and
one whose manifest can't be used, is an error of the row and nothing is parsed or decoded; of
manifests that repeat one counts, but two different ones of one vocab_id are refused; manifests
without vocab_id are met by no row; an empty table of manifests gives errors only.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import ids
from . import bpe, codec, manifest

#: What is broadcast: so many configurations of so many bytes in all at most.
MOST, MOST_BYTES = 4096, 32 << 20
TABLE = "vocab_id string, _bad string, _canvas double, _level int, _base int, _n_merges int, _full array<array<int>>, _hash string"
OWN = ["_canvas", "_level", "_base", "_n_merges", "_full", "_hash", "_bad", "_upper"]


@dataclass(frozen=True)
class Configs:
    """Checked configurations: a small table, and the merges of those that have some."""

    table: DataFrame
    merges: dict[str, list]


def unusable(m: object) -> str | None:
    """Why a manifest can't be used, or None."""
    if not isinstance(m, dict):
        return "is no JSON object"
    canvas, level, merges = m.get("canvas_size"), m.get("max_coord_level"), m.get("merges") or []
    if isinstance(canvas, bool) or not isinstance(canvas, (int, float)) or not math.isfinite(canvas) or canvas <= 0:
        return "has no canvas"
    if isinstance(level, bool) or not isinstance(level, int) or not 1 <= level <= ids.LEVEL:
        return f"has no level of 1 to {ids.LEVEL}"
    base = ids.level_base(level + 1)
    whole = isinstance(merges, list) and all(isinstance(x, list) and len(x) == 3 and all(type(v) is int for v in x) for x in merges)
    if not whole or any(new != base + i or not (0 <= a < new and 0 <= b < new) for i, (a, b, new) in enumerate(merges)):
        return f"has merges that don't follow one another from {base}"
    return None


def load(manifests: DataFrame) -> Configs:
    """The configurations of a table (vocab_id, manifest)."""
    given = manifests.select("vocab_id", "manifest").filter("vocab_id IS NOT NULL").distinct()
    n, size = given.agg(F.count("*"), F.sum(F.octet_length("manifest"))).first()
    if n > MOST or (size or 0) > MOST_BYTES:
        raise EngineError("PAYLOAD_TOO_LARGE", f"more than {MOST} manifests or {MOST_BYTES} bytes of them", limit=MOST)
    rows, merges, seen = [], {}, set()
    for vocab, text in given.collect():  # no more than MOST
        if vocab in seen:
            raise EngineError("INVALID_REQUEST", f"vocab_id {vocab} has several manifests")
        seen.add(vocab)
        try:
            m = manifest.from_json(text or "null")
        except json.JSONDecodeError:
            m = None
        why = unusable(m)
        if why:
            rows.append((vocab, f"manifest of {vocab} {why}", None, None, None, None, None, None))
            continue
        own, base = m.get("merges") or [], ids.level_base(m["max_coord_level"] + 1)
        full = bpe.expansions(own)
        if own:
            merges[vocab] = own
        rows.append((vocab, None, float(m["canvas_size"]), m["max_coord_level"], base, len(own), [full[base + i] for i in range(len(own))], manifest.content_hash(m)))
    return Configs(manifests.sparkSession.createDataFrame(rows, TABLE).coalesce(1), merges)


def joined(df: DataFrame, configs: Configs) -> DataFrame:
    """df with vocab_id and its configuration in the columns OWN; _bad is the error of a row without one."""
    if "vocab_id" not in df.columns:
        df = df.withColumn("vocab_id", F.lit(None).cast("string"))
    rows = df.withColumn("vocab_id", F.coalesce("vocab_id", F.lit(ids.VOCAB_ID))).join(F.broadcast(configs.table), "vocab_id", "left")
    why = F.when(F.col("_level").isNull(), F.coalesce("_bad", F.concat(F.lit("unknown vocab_id "), F.col("vocab_id"))))
    error = F.when(why.isNotNull(), F.struct(F.lit("INVALID_REQUEST").alias("code"), why.alias("message")))
    return rows.withColumns({"_bad": error, "_upper": F.col("_base") + F.col("_n_merges")})


def l1(df: DataFrame, configs: Configs, lean: bool = False, check_size: bool = True) -> DataFrame:
    """df, which has svg and vocab_id, with elements, token_ids and error, and the columns OWN."""
    rows = codec.parsed(joined(df, configs), "_canvas", check_size, "_bad")
    return codec.l1(rows, lean, "_canvas", "_level")


def merged(df: DataFrame, configs: Configs, when: str = "true", tokens: str = "token_ids") -> DataFrame:
    """df with the streams of rows for which when (SQL) holds encoded by the merges of their vocab_id."""
    if not configs.merges:
        return df
    tables = {v: ({(a, b): i for i, (a, b, _) in reversed(list(enumerate(m)))}, m[0][2]) for v, m in configs.merges.items()}
    rows = df.withColumn("_merged", F.expr(f"IF({when} AND _n_merges > 0, {tokens}, NULL)"))
    at, kinds = rows.columns.index("_merged"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    by = rows.columns.index("vocab_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(by).to_pylist(), batch.column(at).to_pylist(), strict=True)
            new = pa.array([None if t is None else bpe.encode_stream(t, *tables[v]) for v, t in pairs], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(run, kinds).withColumn(tokens, F.coalesce("_merged", tokens)).drop("_merged")


def tokenize(df: DataFrame, configs: Configs, level: str = "L1", lean: bool = False, check_size: bool = True) -> DataFrame:
    """codec.tokenize for rows that have svg and vocab_id, with content_hash, that of the row's manifest."""
    rows, up = l1(df, configs, lean, check_size), level.upper()
    said, applied = "cast(NULL AS STRING)", F.lit("L1")
    if up == "L2":
        rows, applied = merged(rows, configs), F.when(F.col("_n_merges") > 0, "L2").otherwise("L1")
        both = "'L2 merges were learned on full (marker) L1 streams; lean+L2 compression may be suboptimal'" if lean else "NULL"
        said = f"IF(_n_merges > 0, {both}, 'L2 merges unavailable; falling back to L1')"
    elif up == "L3":
        said = "'L3 spatial is experimental; emitting L1 substrate'"
    elif up != "L1":
        said = f"'unknown level \\'{level}\\'; emitting L1'"
    out = codec.payload(rows, lean, {"level": applied}, said, "_canvas", "_base").withColumnRenamed("_hash", "content_hash")
    return out.drop(*OWN)


def detokenize(df: DataFrame, configs: Configs, measure: bool = True, keep: bool = False) -> DataFrame:
    """codec.detokenize for rows that have token_ids and vocab_id; keep leaves the columns OWN."""
    if "tokenizer_version" not in df.columns:
        df = df.withColumn("tokenizer_version", F.lit(None).cast("string"))
    rows = joined(df, configs)
    # Without a version nothing else is looked at; the vocabulary is the row's own, so only the range is left to pin.
    pins = codec.pinned(upper="_upper", expected="vocab_id")
    rows = rows.withColumn("error", F.expr(f"IF(tokenizer_version IS NULL OR _bad IS NULL, {pins}, _bad)")).withColumn("_ids", F.when(F.col("error").isNull(), F.col("token_ids")))
    full = "flatten(transform(_ids, t -> IF(t >= _base, get(_full, t - _base), array(t))))"
    rows = rows.withColumn("_ids", F.expr(f"IF(exists(_ids, t -> t >= _base), {full}, _ids)")).drop("_full")
    out = codec.decoded(rows, measure, "_canvas", "_level")
    if measure:
        out = out.withColumn("fidelity", F.col("fidelity").withField("canvas", F.col("_canvas")))
    return out if keep else out.drop(*OWN)
