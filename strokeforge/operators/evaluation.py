"""How faithful decoded drawings are, and what their tokens cost."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, path
from ..functions.sqlgen import let
from ..sources import remote
from ..sources import svg as source
from ..sources.shared import materialize
from . import bpe, codec, render

MISSING_PX = 300.0 * math.sqrt(2)
PERCEPTIBLE_PX = 2.0
#: Bins of a px in which errors are counted.
BINS = 256
TAGS = ("circle", "ellipse", "rect")
ATTRIBUTES = ("cx", "cy", "r", "rx", "ry", "x", "y", "width", "height")
NUMBER = r"[-+]?(?:\d*\.\d+|\d+\.?)(?:[eE][-+]?\d+)?"


def points_of(df: DataFrame, **texts: str) -> DataFrame:
    """df with the points of SVG columns, as they stand: no view box applied, arcs as cubics; none if one doesn't parse.

    texts: new column -> SVG column. All are parsed in one step.
    """
    rows = source.parse(df, **{f"_doc_{name}": svg for name, svg in texts.items()})
    pts = lambda doc: f"coalesce(flatten(transform({codec.elements_of(doc, None)}, e -> {path.all_points('e')})), cast(array() AS ARRAY<STRUCT<x:DOUBLE,y:DOUBLE>>))"
    return rows.withColumns({name: F.expr(pts(f"_doc_{name}")) for name in texts}).drop(*[f"_doc_{name}" for name in texts])


def errors(truth: str, recon: str) -> str:
    """SQL: distances of two arrays of points by place; a point without partner costs MISSING_PX."""
    d = f"IF(i < size({truth}) AND i < size({recon}), sqrt(power({truth}[i].x - {recon}[i].x, 2) + power({truth}[i].y - {recon}[i].y, 2)), {MISSING_PX!r}D)"
    n = f"greatest(size({truth}), size({recon}))"
    return f"IF({n} > 0, transform(sequence(0, {n} - 1), i -> {d}), cast(array() AS ARRAY<DOUBLE>))"


def element_count(svg: str, with_paths: bool = True) -> str:
    return "(" + " + ".join(f"regexp_count({svg}, '<{t}')" for t in (*TAGS, *(["path"] if with_paths else []))) + ")"


def point_errors(truth: DataFrame, recon: DataFrame, keys: list[str]) -> DataFrame:
    """The same for points in long form (keys, pos, x, y): a full outer join by place."""
    a, b = truth.select(*keys, "pos", F.col("x").alias("x1"), F.col("y").alias("y1")), recon.select(*keys, "pos", F.col("x").alias("x2"), F.col("y").alias("y2"))
    return a.join(b, [*keys, "pos"], "full").withColumn("err", F.coalesce(F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")), F.lit(MISSING_PX)))


def scene_scores(df: DataFrame, side: int | None = None, stroke: float = render.STROKE) -> DataFrame:
    """df with truth and svg (decoded) and token_ids, with errs, attr_mean_err, attr_max_err, count_match, render_ssim, n_tokens, n_tokens_bpe.

    side: of the images that are compared, all strokes of one width; without it render_ssim is null, as unknown.
    """
    if side:
        df = render.with_similarity(render.document_lines(df, _truth_lines="truth", _svg_lines="svg"), "_truth_lines", "_svg_lines", side, stroke)
    else:
        df = df.withColumn("render_ssim", F.lit(None).cast("double"))
    rows = points_of(df, _p="truth", _q="svg").withColumn("errs", F.expr(errors("_p", "_q")))
    return rows.withColumns({
        "attr_mean_err": F.expr("IF(size(errs) > 0, aggregate(errs, 0D, (a, e) -> a + e) / size(errs), 0D)"),
        "attr_max_err": F.expr("coalesce(array_max(errs), 0D)"),
        "count_match": F.expr(f"{element_count('truth')} = {element_count('svg')}"),
        "n_tokens": F.size("token_ids"),
        "n_tokens_bpe": F.lit(None).cast("int"),  # no baseline vocabulary offline
    }).drop("_p", "_q")


def summary(scores: DataFrame) -> DataFrame:
    """One row: means over scenes, and the pooled tail of their points' errors.

    Scenes are spread to their errors; what belongs to a scene is read from its first.
    """
    scene = ("attr_mean_err", "attr_max_err", "count_match", "render_ssim", "n_tokens", "n_tokens_bpe")
    scores = materialize(scores.select("errs", *scene), "scene-scores")
    rows = scores.select(F.posexplode_outer("errs").alias("i", "e"), *scene)
    first = F.coalesce("i", F.lit(0)) == 0
    once = {c: F.when(first, F.col(c).cast("double") if c == "count_match" else F.col(c)) for c in scene}
    out = rows.agg(
        F.count_if(first).alias("scenes"), F.round(F.avg(once["attr_mean_err"]), 4).alias("attr_mean_err"), F.round(F.max("attr_max_err"), 4).alias("attr_max_err"), F.round(F.avg(once["count_match"]), 4).alias("count_acc"),
        F.round(F.avg(once["render_ssim"]), 4).alias("render_ssim_mean"), F.count(once["render_ssim"]).alias("render_scenes"), F.sum(once["n_tokens"]).alias("tokens"), F.coalesce(F.sum(once["n_tokens_bpe"]), F.lit(0)).alias("tokens_bpe"),
        F.round(F.avg(once["n_tokens"]) * math.log2(ids.VOCAB), 1).alias("bits_per_icon"), F.count("e").alias("coords_measured"),
        F.round(F.avg((F.col("e") > PERCEPTIBLE_PX).cast("double")), 4).alias("perceptible_err_rate"),
    )
    q = quantiles(scores.select(F.explode("errs").alias("e")), "e", (0.5, 0.9, 0.95, 0.99))
    tail = [F.lit(None if v is None else v).cast("double").alias(f"coord_err_p{p}") for v, p in zip(q, (50, 90, 95, 99), strict=True)]
    return out.withColumn("compression_vs_baseline", F.round(F.try_divide("tokens_bpe", "tokens"), 4)).select("*", *[F.round(c, 4).alias(n) for c, n in zip(tail, ("coord_err_p50", "coord_err_p90", "coord_err_p95", "coord_err_p99"), strict=True)])


def quantiles(rows: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles, interpolated, of a column of errors in px that is stored; nulls are left out.

    Errors are at most MISSING_PX, so bins of 1 / BINS px are a bounded number of rows: their
    counts tell which bins hold the ranks that are sought, and only these bins' distinct values
    are counted in a second pass.
    """
    rows = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("e"), F.floor(F.col(column) * BINS).cast("long").alias("bin"))
    upto = F.sum("n").over(Window.orderBy("bin"))
    bins = rows.groupBy("bin").agg(F.count("*").alias("n")).withColumn("upto", upto).orderBy("bin").collect()  # MISSING_PX * BINS rows at most
    if not bins:
        return [None] * len(shares)
    total = bins[-1]["upto"]
    places = [(math.floor(p * (total - 1)), math.ceil(p * (total - 1)), p * (total - 1) % 1) for p in shares]
    ends = [b["upto"] for b in bins]
    at = lambda rank: bins[bisect.bisect_right(ends, rank)]
    wanted = sorted({at(r)["bin"] for lo, hi, _ in places for r in (lo, hi)})
    values = rows.filter(F.col("bin").isin(wanted)).groupBy("bin", "e").agg(F.count("*").alias("n"))
    within = values.withColumn("upto", F.sum("n").over(Window.partitionBy("bin").orderBy("e")))
    ranks = {r: (at(r)["bin"], r - (at(r)["upto"] - at(r)["n"])) for lo, hi, _ in places for r in (lo, hi)}
    hit = " OR ".join(f"(bin = {b} AND upto > {k} AND upto - n <= {k})" for b, k in set(ranks.values()))
    found = within.filter(hit).collect()  # a row for each rank
    value = lambda r: next(x["e"] for x in found if x["bin"] == ranks[r][0] and x["upto"] - x["n"] <= ranks[r][1] < x["upto"])
    return [value(lo) + (value(hi) - value(lo)) * part for lo, hi, part in places]


def builtin_eval(docs: DataFrame, level: str = "L1", lean: bool = False, merges: list | None = None, side: int | None = None) -> DataFrame:
    """Scores of every document that tokenizes: encode, decode, compare with the geometry before quantising."""
    rows = codec.normalized_svg(codec.parsed(docs)).filter("error IS NULL").select("doc_id", F.col("svg").alias("source"), "truth", "elements")
    rows = codec.l1(rows, lean).drop("elements")
    rows = rows.withColumn("tokenizer_version", F.lit(ids.TOKENIZER_VERSION))
    return scene_scores(codec.detokenize(rows, merges).filter("error IS NULL"), side)


def restyled(svg: str, width: float) -> str:
    """SQL: svg with every stroke of one width; paths get one where there is none."""
    w = f'stroke-width="{width}"'
    return f"IF(contains({svg}, 'stroke-width='), regexp_replace({svg}, 'stroke-width=\"[^\"]*\"', '{w}'), replace({svg}, '<path ', '<path {w} '))"


def values(df: DataFrame, svg: str, key: str = "doc_id") -> DataFrame:
    """key, tag, attr, n, v: numbers of shapes' attributes by size, and of paths by place."""
    number = NUMBER.replace("\\", "\\\\")  # for a SQL literal
    out = None
    for tag in TAGS:
        found = df.select(key, F.explode(F.expr(f"regexp_extract_all({svg}, '<{tag}\\\\b[^>]*>', 0)")).alias("e"))
        pairs = F.array(*[F.struct(F.lit(a).alias("attr"), F.expr(f"try_cast(nullif(regexp_extract(e, '[ \"]{a}=\"({number})\"', 1), '') AS DOUBLE)").alias("v")) for a in ATTRIBUTES])
        part = found.select(key, F.lit(tag).alias("tag"), F.explode(pairs).alias("p")).select(key, "tag", "p.attr", "p.v").filter("v IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    ranked = out.withColumn("n", F.row_number().over(Window.partitionBy(key, "tag", "attr").orderBy("v")))
    ds = f"regexp_extract_all({svg}, '\\\\bd=\"([^\"]*)\"', 1)"
    paths = df.select(key, F.posexplode(F.expr(f"flatten(transform({ds}, d -> regexp_extract_all(d, '({number})', 1)))")).alias("n", "v"))
    return ranked.select(key, "tag", "attr", "n", "v").unionByName(paths.select(key, F.lit("path").alias("tag"), F.lit("d").alias("attr"), (F.col("n") + 1).alias("n"), F.col("v").cast("double")))


def value_fidelity(df: DataFrame, truth: str, recon: str, key: str = "doc_id") -> DataFrame:
    """key, attr_max_err, attr_mean_err (infinite where nothing pairs), count_match, of every row of df."""
    k = [key, "tag", "attr", "n"]
    pairs = values(df, truth, key).alias("a").join(values(df, recon, key).alias("b"), k).select(key, F.abs(F.col("a.v") - F.col("b.v")).alias("e"))
    worst = pairs.groupBy(key).agg(F.max("e").alias("attr_max_err"), F.avg("e").alias("attr_mean_err"))
    same = df.select(key, F.expr(f"{element_count(truth, False)} = {element_count(recon, False)}").alias("count_match"))
    return same.join(worst, key, "left").fillna(float("inf"), ["attr_max_err", "attr_mean_err"])


def _box(x: np.ndarray, win: int) -> np.ndarray:
    r = win // 2
    p = np.pad(x, r, mode="edge")
    return np.lib.stride_tricks.sliding_window_view(p, (2 * r + 1, 2 * r + 1)).mean((2, 3))


def ssim_pair(a: np.ndarray, b: np.ndarray, win: int = 7) -> float:
    """Mean structural similarity of two images in [0, 1] with a box window."""
    if a.shape != b.shape:
        return 0.0
    ma, mb = _box(a, win), _box(b, win)
    va, vb, cov = _box(a * a, win) - ma * ma, _box(b * b, win) - mb * mb, _box(a * b, win) - ma * mb
    score = (2 * ma * mb + 1e-4) * (2 * cov + 9e-4) / np.maximum((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4), 1e-12)
    return float(np.clip(score.mean(), -1.0, 1.0))


#: Images that are compared at a time.
STACK = 512


def _stack(column: pa.Array, side: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, side, side)


def similar(x: pa.Array, y: pa.Array, side: int) -> list[float | None]:
    """The similarity of images by place: square ones are compared as stacks; null ones, or of another size, one by one."""
    square = pc.fill_null(pc.and_(*(pc.equal(pc.list_value_length(v), side * side) for v in (x, y))), False)
    if pc.all(square).as_py() and not x.flatten().null_count and not y.flatten().null_count:
        return render.ssim(_stack(x, side), _stack(y, side)).tolist()
    image = lambda v: np.reshape(v, (side, -1)).astype(float)
    return [None if u is None or v is None else ssim_pair(image(u), image(v)) for u, v in zip(x.to_pylist(), y.to_pylist(), strict=True)]


def with_ssim(df: DataFrame, a: str, b: str, side: int, name: str = "ssim") -> DataFrame:
    """df with the similarity of two columns of side * side grey values."""

    @F.arrow_udf("double")
    def similarity(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([v for at in range(0, len(x), STACK) for v in similar(x.slice(at, STACK), y.slice(at, STACK), side)], pa.float64())

    return df.withColumn(name, similarity(a, b))


def structure_score(t: str = "token_ids") -> str:
    """SQL: share of structural checks that a stream passes."""
    heads = f"filter(sequence(0, greatest(size({t}) - 2, 0)), i -> size({t}) > 1 AND (({t}[i] >= 10 AND {t}[i] < 18) OR ({t}[i] >= 20 AND {t}[i] < 24)))"
    inner = f"slice({t}, 2, greatest(size({t}) - 2, 0))"
    return f"IF(size({t}) = 0, 0D, {let({'hs': heads}, f'(IF({t}[0] = 1, 1, 0) + IF({t}[size({t}) - 1] = 2, 1, 0) + size(filter(hs, i -> {t}[i + 1] >= {ids.BASE})) + IF(size({t}) > 2 AND array_contains({inner}, 0), 0, 1)) / cast(3 + size(hs) AS DOUBLE)')})"


def geometry_score(t: str = "token_ids") -> str:
    """SQL: whether a stream has coordinates, how many differ, and whether there are as many as commands need."""
    cs, n = f"filter({t}, x -> x >= {ids.BASE})", f"size(filter({t}, x -> x >= 10 AND x < 24))"
    body = "(IF(size(cs) > 0, 1D, 0D) + IF(size(cs) > 0, size(array_distinct(cs)) / cast(size(cs) AS DOUBLE), 0D) + IF(n > 0 AND size(cs) / cast(n AS DOUBLE) BETWEEN 0.5 AND 5, 1D, 0D)) / (1 + IF(size(cs) > 0, 1, 0) + IF(n > 0, 1, 0))"
    return f"IF(size({t}) = 0, 0D, {let({'cs': cs, 'n': n}, body)})"


def category(t: str = "token_ids") -> str:
    first = f"get(filter({t}, x -> x IN (20, 22, 21, 11, 14)), 0)"
    return f"CASE {first} WHEN 20 THEN 'circle' WHEN 22 THEN 'rect' WHEN 21 THEN 'ellipse' WHEN 11 THEN 'path' WHEN 14 THEN 'curve' ELSE 'unknown' END"


def generation(samples: DataFrame) -> DataFrame:
    """One row of quality figures of samples (token_ids, is_valid); without samples they are null."""
    uniq = "IF(size(token_ids) > 0, size(array_distinct(token_ids)) / cast(size(token_ids) AS DOUBLE), NULL)"
    return samples.agg(
        F.count("*").alias("n_samples"), F.round(F.avg(F.col("is_valid").cast("double")), 6).alias("valid_svg_rate"), F.round(F.avg(F.expr(structure_score())), 6).alias("structural_score"),
        F.round((F.try_divide(F.countDistinct("token_ids"), F.count("*")) + F.coalesce(F.avg(F.expr(uniq)), F.lit(0.0))) / 2, 6).alias("diversity_score"), F.round(F.avg(F.expr(geometry_score())), 6).alias("geometric_score"),
        F.round(F.avg(F.size("token_ids")), 6).alias("avg_token_length"), F.min(F.size("token_ids")).alias("min_token_length"), F.max(F.size("token_ids")).alias("max_token_length"),
    )


def categories(samples: DataFrame) -> DataFrame:
    return samples.groupBy(F.expr(category()).alias("category")).agg(F.count("*").alias("n"))


def report(samples: DataFrame) -> DataFrame:
    """The figures of generation() and the categories of samples (token_ids, is_valid) as lines of text: line, text.

    Categories come after the figures, most frequent first, then by name; without samples only the figures come.
    """
    shown = [("samples", "%d", "n_samples"), ("valid documents", "%.1f%%", "valid_svg_rate * 100"), ("structure", "%.3f", "structural_score"), ("geometry", "%.3f", "geometric_score"), ("diversity", "%.3f", "diversity_score"), ("mean length", "%.1f", "avg_token_length")]
    texts = [f"format_string('%-16s {form}', '{name}', coalesce({value}, 0))" for name, form, value in shown]
    texts.append("format_string('%-16s %d to %d', 'lengths', coalesce(min_token_length, 0), coalesce(max_token_length, 0))")
    head = generation(samples).select(F.posexplode(F.expr(f"array({', '.join(texts)})")).alias("line", "text"))
    # A handful of categories: their order and share are of an array of one row.
    kinds = categories(samples).agg(F.expr("array_sort(collect_list(struct(-n AS n, category)))").alias("c"))
    one = "format_string('  %-14s %d (%.1f%%)', x.category, -x.n, 100 * x.n / aggregate(c, 0L, (s, y) -> s + y.n))"
    tail = kinds.select(F.posexplode(F.expr(f"transform(c, x -> {one})")).alias("line", "text")).withColumn("line", F.col("line") + len(texts))
    return head.unionByName(tail)


def render_figures(masks: DataFrame, key: str = "sample_id", mask: str = "mask", ahead: int = 5, ink: str | None = None) -> DataFrame:
    """One row for ink masks (arrays of booleans): share of ink, of masks neither empty nor full, and the mean difference to the next few.

    ink: a column of the share of ink; that of the mask by default.

    Next is by place in the order of keys, whatever gaps they have. Places are the count of
    lesser keys: of the parts that a range exchange makes, and within a part. Neighbours come
    from a join on places.
    """
    parted = masks.select(F.col(key).cast("long").alias("k"), F.col(mask).alias("m"), F.hash(mask).alias("tie"), F.expr(f"aggregate({mask}, 0D, (a, v) -> a + IF(v, 1, 0)) / size({mask})" if ink is None else ink).cast("double").alias("ink")).repartitionByRange("k", "tie").withColumn("part", F.spark_partition_id())
    parted = materialize(parted, "masks")
    sizes = parted.groupBy("part").agg(F.count("*").alias("n"))  # a row a part
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("part").orderBy("k", "tie"))
    ranked = parted.join(F.broadcast(before.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part").select((F.col("before") + within).alias("k"), "m", "ink")
    ranked = materialize(ranked, "masks-ranked")
    one = ranked.agg(F.count("*").alias("n"), F.round(F.avg("ink"), 6).alias("mean_ink"), F.round(F.avg(F.expr("IF(ink BETWEEN 0.005 AND 0.6, 1D, 0D)")), 6).alias("non_degenerate"))
    # Each mask meets the next few and no others: its place is told to those before it.
    right = ranked.select(F.col("m").alias("m2"), F.explode(F.expr(f"transform(sequence(1, {ahead}), i -> k - i)")).alias("k"))
    pairs = ranked.join(right, "k")
    diff = pairs.agg(F.round(F.avg(F.expr("aggregate(zip_with(m, m2, (a, b) -> IF(a = b, 0D, 1D)), 0D, (a, v) -> a + v) / size(m)")), 6).alias("diversity"))
    return one.join(F.broadcast(diff))


def gates(docs: DataFrame) -> DataFrame:
    """One row of what a corpus must pass: rates of parsing, round trip, grammar, bound; pooled errors."""
    rows = codec.l1(codec.parsed(docs)).withColumn("tokenizer_version", F.lit(ids.TOKENIZER_VERSION)).withColumnRenamed("error", "_parse_error")
    back = codec.detokenize(rows.drop("svg"))
    pts = f"flatten(transform(elements, e -> {path.all_points('e')}))"
    err = f"transform({pts}, q -> sqrt(power(q.x - {ids.x_of(ids.coord_id('q.x', 'q.y'))}, 2) + power(q.y - {ids.y_of(ids.coord_id('q.x', 'q.y'))}, 2)))"
    ok = F.col("_parse_error").isNull()
    back = back.withColumn("errs", F.expr(err)).withColumn("worst", F.expr("array_max(errs)")).withColumn("mean", F.expr("aggregate(errs, 0D, (a, v) -> a + v) / size(errs)"))
    back = materialize(back.select(ok.alias("ok"), (ok & F.col("svg").isNotNull()).alias("back"), "valid", "worst", "mean"), "gates")
    p99 = quantiles(back, "worst", (0.99,))[0]
    return back.agg(
        F.count("*").alias("icons"), F.round(F.avg(F.col("ok").cast("double")), 4).alias("parse_rate"), F.round(F.avg(F.col("back").cast("double")), 4).alias("roundtrip_rate"),
        F.round(F.avg(F.coalesce(F.col("valid"), F.lit(False)).cast("double")), 4).alias("fsa_valid_rate"),
        F.round(F.avg(F.expr(f"IF(coalesce(worst, 0D) <= {ids.cell() / 2 * math.sqrt(2) + 1e-6!r}D, 1D, 0D)")), 4).alias("within_bound_rate"),
        F.round(F.avg("mean"), 4).alias("coord_err_mean"), F.round(F.max("worst"), 4).alias("coord_err_max"), F.round(F.lit(p99).cast("double"), 4).alias("coord_err_p99"),
    )


def merge_gates(streams: DataFrame, merges: list) -> DataFrame:
    """One row: mean lengths of streams before and after merging, and the share that comes back as it was."""
    both = bpe.encode(streams.withColumn("_l1", F.col("token_ids")), merges).withColumn("_back", F.expr(bpe.expanded("token_ids", merges)))
    return both.agg(
        F.count("*").alias("icons"), F.round(F.avg(F.size("_l1")), 4).alias("l1_tokens"), F.round(F.avg(F.size("token_ids")), 4).alias("l2_tokens"),
        F.round(F.avg((F.col("_back") == F.col("_l1")).cast("double")), 4).alias("lossless_rate"),
    )


def refusals(docs: DataFrame) -> DataFrame:
    """code, n of the documents that are not tokenized."""
    return codec.parsed(docs).filter("error IS NOT NULL").groupBy(F.col("error.code").alias("code")).agg(F.count("*").alias("n"))


def determinism(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: the share of documents that give the same stream in two runs, the second over rows dealt anew."""
    one = codec.tokenize(docs).select(key, F.col("token_ids").alias("a"))
    # Another number of parts than before, and more than there are cores, whose shares then come out even.
    two = codec.tokenize(docs.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism - 1)).select(key, F.col("token_ids").alias("b"))
    return one.join(two, key).agg(F.count("*").alias("icons"), F.round(F.avg(F.col("a").eqNullSafe(F.col("b")).cast("double")), 4).alias("same_rate"))


def fidelity(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row: what quantising costs points, and whether all keep the bound."""
    t = ids.coord_id(x, y)
    e = points.select(F.expr(f"sqrt(power({x} - {ids.x_of(t)}, 2) + power({y} - {ids.y_of(t)}, 2))").alias("err"))
    bound = F.expr(ids.bound())
    return e.agg(
        F.round(F.max("err"), 6).alias("max_error"), F.round(F.avg("err"), 6).alias("mean_error"), F.round(F.sqrt(F.avg(F.col("err") * F.col("err"))), 6).alias("rms_error"),
        F.round(F.first(bound), 6).alias("theoretical_bound"), (F.max("err") <= F.first(bound) + 1e-6).alias("within_bound"), F.count("*").alias("n_points"),
    )


def value_summary(scores: DataFrame) -> DataFrame:
    """One row from value_fidelity."""
    return scores.agg(
        F.count("*").alias("scenes"), F.round(F.max("attr_max_err"), 6).alias("attr_max_err"), F.round(F.avg("attr_mean_err"), 6).alias("attr_mean_err"), F.round(F.avg(F.col("count_match").cast("double")), 6).alias("count_acc")
    )


def external_eval(docs: DataFrame, encode, decode) -> DataFrame:
    """Scores of another tokenizer: encode(svg) -> ids and decode(ids) -> svg run in an Arrow map; documents that fail are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("svg").to_pylist(), strict=True):
                try:
                    t = list(encode(text))
                    rows.append((doc, text, t, decode(t)))
                except Exception:  # the other side's failure is its own
                    continue
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.string())], names=["doc_id", "truth", "token_ids", "svg"])

    rows = docs.select(F.col("doc_id").cast("long"), "svg").filter("svg IS NOT NULL")
    return scene_scores(rows.mapInArrow(run, "doc_id long, truth string, token_ids array<int>, svg string"))


def remote_eval(docs: DataFrame, tokenizer: remote.Remote) -> DataFrame:
    """Scores of a tokenizer behind HTTP; documents that fail are left out. Documents are asked for once: what comes back is stored."""
    rows = docs.select(F.col("doc_id").cast("long"), "svg").filter("svg IS NOT NULL")
    back = materialize(remote.round_trip(rows, tokenizer), "remote")
    return scene_scores(back.filter("error IS NULL").select("doc_id", F.col("svg").alias("truth"), "token_ids", F.col("decoded").alias("svg")))
