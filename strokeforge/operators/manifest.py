"""The vocabulary manifest: its rows, its JSON, and its hash."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids


def build(merges: list | None = None, vocab_id: str = ids.VOCAB_ID, canvas: float = ids.CANVAS, level: int = ids.LEVEL) -> dict:
    name = lambda table: {str(k): v for k, v in table.items()}
    layout = [{"level": k, "start_id": ids.level_base(k), "grid": 2**k, "n_tokens": 4**k} for k in range(level + 1)]
    return {
        "vocab_id": vocab_id, "tokenizer_version": ids.TOKENIZER_VERSION, "canvas_size": float(canvas), "max_coord_level": level, "vocab_size": ids.level_base(level + 1), "coord_token_base": ids.BASE, "level_layout": layout,
        "special": name(ids.SPECIAL), "command": name(ids.COMMAND), "continuity": name(ids.CONTINUITY), "curvature": {str(ids.CURVATURE + k): f"CURV@{k}" for k in range(ids.CURVATURE_BINS)},
        "composite": name(ids.COMPOSITE), "spatial": name(ids.SPATIAL), "merges": merges, "merge_base_id": ids.level_base(level + 1) if merges else None,
    }


def to_json(manifest: dict, indent: int | None = 2) -> str:
    return json.dumps(manifest, ensure_ascii=False, indent=indent, sort_keys=True)


def from_json(text: str) -> dict:
    return json.loads(text)


def content_hash(manifest: dict) -> str:
    """The first 16 hex digits of the SHA-256 of the canonical JSON."""
    return hashlib.sha256(json.dumps(manifest, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def vocabulary(spark: SparkSession) -> DataFrame:
    """id, kind, symbol, level, qx, qy of all ids."""
    t = "cast(id AS INT)"
    return spark.range(ids.VOCAB).select(F.expr(t).alias("token_id")).withColumns({
        "kind": F.expr(ids.kind("token_id")), "symbol": F.expr(ids.symbol("token_id")), "level": F.expr(ids.level_of("token_id")), "qx": F.expr(ids.qx("token_id")), "qy": F.expr(ids.qy("token_id")),
    })


def summary(spark: SparkSession) -> DataFrame:
    return vocabulary(spark).groupBy("kind").agg(F.count("*").alias("n"))


def lookup(manifests: DataFrame, wanted: DataFrame) -> DataFrame:
    """vocab_id of wanted with manifest, content_hash and error, from a table (vocab_id, manifest JSON)."""
    out = wanted.select("vocab_id").join(manifests, "vocab_id", "left")
    missing = F.struct(F.lit("INVALID_REQUEST").alias("code"), F.concat(F.lit("unknown vocab_id "), F.col("vocab_id")).alias("message"))
    return out.withColumn("error", F.when(F.col("manifest").isNull(), missing))


def stored(spark: SparkSession, manifests: list[dict]) -> DataFrame:
    return spark.createDataFrame([(m["vocab_id"], to_json(m, None), content_hash(m)) for m in manifests], "vocab_id string, manifest string, content_hash string")
