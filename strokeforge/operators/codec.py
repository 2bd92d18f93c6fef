"""Tokenizing and detokenizing whole documents: DataFrame in, DataFrame out, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decode, grammar, ids, path, tokens
from ..functions.sqlgen import let, lit
from ..sources import svg as source
from . import bpe, detok


def with_commands(df: DataFrame, canvas: float | str | None = ids.CANVAS, flatten: bool = True) -> DataFrame:
    """df, which has doc, with elements: the drawn commands of each, in order.

    Commands are moved by all transforms and, with a canvas, by the view box; arcs become cubics.
    """
    return df.withColumn("elements", F.expr(elements_of("doc", canvas, flatten)))


def elements_of(doc: str, canvas: float | str | None = ids.CANVAS, flatten: bool = True) -> str:
    """SQL: the drawn commands of each element of a parsed document."""
    start = path.viewbox_matrix(f"{doc}.viewbox", canvas) if canvas else path.IDENTITY
    # The matrix of an element: the view box's, then its groups', then its own.
    moved = path.applied("c", "m")
    cmds = let({"c": path.shape("e.tag", "e.v", "e.d"), "m": path.transform_matrix("e.transforms", "root")}, path.without_arcs(moved) if flatten else moved, path.COMMANDS)
    return let({"root": start}, f"transform({doc}.elements, e -> {cmds})", f"array<{path.COMMANDS}>")


def parsed(df: DataFrame, canvas: float | str | None = ids.CANVAS, check_size: bool = True, refused: str | None = None) -> DataFrame:
    """df, which has svg, with doc, elements and error: STRUCT<code, message>. Refused documents are not parsed.

    refused: SQL of an error that comes before those of the text.
    """
    why = source.guard("svg", check_size)
    kept = df.withColumn("_refused", F.expr(f"coalesce({refused}, {why})" if refused else why))
    rows = source.parse(kept.withColumn("_svg", F.when(F.col("_refused").isNull(), F.col("svg"))), doc="_svg").drop("_svg")
    failed = F.when(F.col("doc.error").isNotNull(), F.struct(F.lit("PARSE_ERROR").alias("code"), F.col("doc.error").alias("message")))
    return with_commands(rows, canvas).withColumn("error", F.coalesce("_refused", failed)).drop("_refused")


def l1(df: DataFrame, lean: bool = False, canvas: float | str = ids.CANVAS, level: int | str = ids.LEVEL) -> DataFrame:
    """df, which has elements, with token_ids."""
    body = tokens.lean("e", level, canvas) if lean else tokens.full("e", level=level, canvas=canvas)
    return df.withColumn("token_ids", F.when(F.col("elements").isNotNull(), F.expr(tokens.bracketed(f"transform(elements, e -> {body})"))))


def ratio(svg: str, ids_: str) -> str:
    """SQL: characters of a document for each of its tokens; 0 without tokens."""
    return f"IF(size({ids_}) > 0, bround(length({svg}) / size({ids_}), 4), 0D)"


def clamped_count(elements: str = "elements", canvas: float | str = ids.CANVAS) -> str:
    """SQL: how many points lie beyond the canvas."""
    out = f"aggregate({path.all_points('e')}, 0, (n, q) -> n + IF(q.x < 0 OR q.x > {ids.number(canvas)} OR q.y < 0 OR q.y > {ids.number(canvas)}, 1, 0))"
    return f"aggregate(transform({elements}, e -> {out}), 0, (a, b) -> a + b)"


def tokenize(df: DataFrame, level: str = "L1", lean: bool = False, merges: list | None = None, check_size: bool = True) -> DataFrame:
    """df, which has svg, with the payload of each document: token_ids, tokens, counts, warnings, error.

    L2 applies merges; L3 gives L1; an unknown level gives L1 with a warning.
    """
    rows = l1(parsed(df, check_size=check_size), lean)
    up = level.upper()
    said = {"L1": "cast(NULL AS STRING)", "L3": "'L3 spatial is experimental; emitting L1 substrate'"}.get(up, f"'unknown level ''{level}''; emitting L1'".replace("''", "\\'"))
    applied = "L1"
    if up == "L2":
        if merges:
            rows, applied = bpe.encode(rows, merges), "L2"
            said = "'L2 merges were learned on full (marker) L1 streams; lean+L2 compression may be suboptimal'" if lean else "cast(NULL AS STRING)"
        else:
            said = "'L2 merges unavailable; falling back to L1'"
    return payload(rows, lean, {"vocab_id": F.lit(ids.VOCAB_ID), "level": F.lit(applied)}, said)


def payload(rows: DataFrame, lean: bool, pins: dict, said: str, canvas: float | str = ids.CANVAS, merge_base: int | str = ids.VOCAB) -> DataFrame:
    """rows, which have doc, elements and token_ids, as payloads with the given vocab_id and level; said is SQL of a warning or null."""
    rows = rows.withColumn("n_clamped", F.expr(clamped_count(canvas=canvas)))
    rows = rows.withColumns({
        "tokenizer_version": F.lit(ids.TOKENIZER_VERSION), **pins, "lean": F.lit(lean),
        "tokens": F.expr(tokens.symbols("token_ids", merge_base)),
        "n_commands": F.expr("aggregate(elements, 0, (n, e) -> n + size(e))"),
        "n_tokens": F.expr("size(token_ids)"),
        "n_elements": F.expr("size(filter(elements, e -> size(e) > 0))"),
        "compression_ratio": F.expr(ratio("svg", "token_ids")),
        "normalization": F.expr("named_struct('viewBox_applied', doc.viewbox IS NOT NULL, 'transforms_flattened', size(filter(zip_with(doc.elements, elements, (x, y) -> length(x.transform) > 0 AND size(y) > 0), z -> z)))"),
        "warnings": F.expr(f"filter(array(IF(n_clamped > 0, concat(n_clamped, ' coordinate(s) outside viewBox were clamped to canvas'), NULL), {said}), w -> w IS NOT NULL)"),
    })
    return rows.drop("doc", "elements")


def project(payload: DataFrame, fields: list[str], keys: list[str] = ()) -> DataFrame:
    """The payload's whitelisted fields, and those that are always kept."""
    always = ["tokenizer_version", "vocab_id", "level", "lean", "n_tokens", "warnings"]
    return payload.select(*[c for c in payload.columns if c in {*fields, *always, *keys}])


def pinned(version: str = "tokenizer_version", vocab: str = "vocab_id", tokens_: str = "token_ids", upper: int | str = ids.VOCAB, expected: str = lit(ids.VOCAB_ID)) -> str:
    """SQL: STRUCT<code, message> of what refuses a stream before decoding, or null; upper and expected may be SQL."""
    bad = tokens.bad_id(tokens_, upper)
    err = lambda code, message: f"named_struct('code', '{code}', 'message', {message})"
    return (
        f"CASE WHEN {version} IS NULL THEN {err('VERSION_REQUIRED', lit('tokenizer_version is required for detokenize'))} "
        f"WHEN substring_index({version}, '-', -1) <> '{ids.FORMAT}' THEN {err('VOCAB_MISMATCH', f"concat('tokenizer_version ', {version}, ' != {ids.TOKENIZER_VERSION}')")} "
        f"WHEN {vocab} IS NOT NULL AND {vocab} <> {expected} THEN {err('VOCAB_MISMATCH', f"concat('vocab_id ', {vocab}, ' != ', {expected})")} "
        f"WHEN {bad} IS NOT NULL THEN {err('VOCAB_MISMATCH', f"concat('token id ', {bad}, ' out of range [0,', {upper}, ')')")} END"
    )


def detokenize(df: DataFrame, merges: list | None = None, measure: bool = True) -> DataFrame:
    """df, which has token_ids and maybe tokenizer_version and vocab_id, with svg, valid, repaired, fidelity, error."""
    for name, value in (("tokenizer_version", None), ("vocab_id", None)):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value).cast("string"))
    upper = ids.VOCAB + len(merges or [])
    rows = df.withColumn("error", F.expr(pinned(upper=upper))).withColumn("_ids", F.when(F.col("error").isNull(), F.col("token_ids")))
    if merges:
        rows = rows.withColumn("_ids", F.expr(bpe.expanded("_ids", merges)))
    return decoded(rows, measure)


def decoded(rows: DataFrame, measure: bool = True, canvas: float | str = ids.CANVAS, level: int | str = ids.LEVEL) -> DataFrame:
    """rows, which have token_ids and _ids, the stream without merges, with svg, valid, repaired, fidelity."""
    rows = rows.withColumn("valid", F.expr(grammar.is_valid("_ids")))
    rows = rows.withColumn("repaired", ~F.col("valid")).withColumn("_ids", F.expr(f"IF(valid, _ids, {grammar.repaired('_ids')})"))
    rows = detok.with_elements(rows, "_ids", "_elements", canvas, level)
    out = {"n_tokens": F.expr("size(token_ids)"), "svg": F.expr(decode.document("_elements", canvas))}
    if measure:
        out["fidelity"] = F.expr(decode.expected_fidelity("_ids", canvas))
    return rows.withColumns(out).drop("_ids", "_elements")


def normalized_svg(df: DataFrame, stroke: float = 1.0) -> DataFrame:
    """df, which has elements, with truth: the geometry before quantising in the style of decoded documents."""
    text = f"filter(transform(elements, e -> {path.path_text('e')}), d -> d <> '')"
    paths = f"transform({text}, d -> concat('<path d=\"', d, '\" fill=\"none\" stroke=\"black\" stroke-width=\"{stroke}\"/>'))"
    return df.withColumn("truth", F.expr(decode.document(paths)))
