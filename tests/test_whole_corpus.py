"""The queries over every drawing and point against brute force."""

import math

import pytest

from strokeforge.plans import catalog as core
from strokeforge.plans import fixtures as fx

DIR = "/root/testdata/sf0.001"
K = 0.5522847498307936


def shape(k, size):
    """Points of a part's drawing in its moved group: a curve gives its control points too."""
    tx, ty, kind = k % 5, k % 3, k % 4
    if kind in (1, 3):
        x, y, w, h = 10 + k % 150 + tx, 10 + k * 3 % 150 + ty, size % 60 + 20, size % 40 + 20
        return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    cx, cy = 60 + k % 180 + tx, 60 + k * 7 % 180 + ty
    rx, ry = (size % 30 + 2,) * 2 if kind == 0 else (size % 20 + 30, size % 15 + 2)
    unit = [(1, 0), (1, K), (K, 1), (0, 1), (-K, 1), (-1, K), (-1, 0), (-1, -K), (-K, -1), (0, -1), (K, -1), (1, -K), (1, 0)]
    return [(cx + rx * u, cy + ry * v) for u, v in unit]


def centre(v):
    return (min(math.floor(max(0, min(v, 299.999999)) / 4.6875), 63) + 0.5) * 4.6875


def one_decimal(v):
    return float(f"{v:.1f}")


def errors(points, of, digits=15):
    return [math.hypot(round(x, digits) - of(centre(x)), round(y, digits) - of(centre(y))) for x, y in points]


@pytest.fixture(scope="module")
def parts(spark):
    return {r.p_partkey: shape(r.p_partkey, r.p_size) for r in fx.table(spark, DIR, "part").collect()}


def test_every_drawing_is_scored(spark, parts):
    # The truth that scores are held against is text of three decimals.
    want = {k: errors(p, one_decimal, 3) for k, p in parts.items()}
    got = {r.doc_id: r for r in core.QUERIES["e3_scene_scores"](spark, DIR).collect()}
    assert got.keys() == want.keys() and all(r.count_match for r in got.values())
    for k, e in want.items():
        assert (got[k].attr_mean_err, got[k].attr_max_err) == pytest.approx((sum(e) / len(e), max(e)), abs=1e-5), k
    s, pooled = core.QUERIES["e4_summary"](spark, DIR).first(), sorted(x for e in want.values() for x in e)
    assert (s.scenes, s.coords_measured) == (len(parts), len(pooled))
    assert s.attr_max_err == pytest.approx(pooled[-1], abs=1e-4) and s.perceptible_err_rate == pytest.approx(sum(x > 2 for x in pooled) / len(pooled), abs=1e-4)


def test_gates_cover_every_drawing(spark, parts):
    e = [errors(p, float) for p in parts.values()]
    g = core.QUERIES["e13_corpus_gates"](spark, DIR).first()
    assert g.icons == len(parts) and g.within_bound_rate == 1.0
    assert (g.coord_err_mean, g.coord_err_max) == pytest.approx((sum(sum(x) / len(x) for x in e) / len(e), max(map(max, e))), abs=1e-4)


def test_normalized_svg_of_every_drawing(spark, parts):
    got = {r.doc_id: r.truth for r in core.QUERIES["g16_normalized_svg"](spark, DIR).collect()}
    assert got.keys() == parts.keys()
    for k, p in parts.items():
        d = got[k].split('d="')[1].split('"')[0]
        numbers = [float(x) for x in d.split() if x[0] not in "MLCZ"]
        assert numbers == pytest.approx([v for xy in p for v in xy], abs=6e-4), k


def test_points_beyond_the_canvas_count(spark):
    points = [(r.x, r.y) for r in fx.points(spark, DIR).collect()]
    e, q = errors(points, float), core.QUERIES["q11_fidelity"](spark, DIR).first()
    assert q.n_points == len(points) and q.max_error == pytest.approx(max(e), abs=1e-5) and not q.within_bound


def test_parts_are_dealt_to_all_cores(spark):
    """One small file of parts is much work: queries over them ran in one task."""
    from strokeforge.plans import drawn

    cores = spark.sparkContext.defaultParallelism
    assert drawn.parts(spark, DIR, svg="'<svg/>'").rdd.getNumPartitions() >= cores
    assert drawn.documents(spark, DIR).rdd.getNumPartitions() >= cores


def test_absolute_commands_need_no_state(spark):
    """Paths of M, L, C and Q alone are made without a fold, as the fold makes them."""
    from strokeforge.functions import path

    texts = [("M1 2L-0 4C1 1 2 2 3 3Q4 4 5 5M9 9 8 8",), ("",), ("L5 5",)]
    rows = spark.createDataFrame(texts, "d string")
    got = [r.p for r in rows.selectExpr(f"{path.parsed('d')} AS p").collect()]
    folded = [r.p for r in rows.selectExpr(f"{path.parsed("concat(d, 'm0 0')")} AS p").collect()]
    assert got == [p[:-1] for p in folded]
    assert [(k.c, k.sx, k.ex) for k in got[0]] == [("M", 0, 1), ("L", 1, 0), ("C", 0, 3), ("Q", 3, 5), ("M", 5, 9), ("L", 9, 8)]


def test_second_run_uses_all_cores(spark):
    """What is dealt anew has more parts than there are cores."""
    from strokeforge.operators import codec, evaluation

    dealt, tokenize = [], codec.tokenize
    try:
        codec.tokenize = lambda df, *a, **k: dealt.append(df.rdd.getNumPartitions()) or tokenize(df, *a, **k)
        evaluation.determinism(spark.createDataFrame([(i, "<svg><path d='M1 1L2 2'/></svg>") for i in range(3)], "doc_id long, svg string"))
    finally:
        codec.tokenize = tokenize
    assert dealt[1] > spark.sparkContext.defaultParallelism and dealt[1] != dealt[0]
