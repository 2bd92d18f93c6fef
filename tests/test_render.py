import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strokeforge.operators import codec, evaluation, render

HEAD = '<svg viewBox="0 0 300 300">'


def image(spark, svg, side=64, stroke=3.0):
    df = render.document_lines(spark.createDataFrame([(svg,)], "svg string"), lines="svg").select("lines")
    row = render.with_image(df, "lines", side, stroke).first()
    return np.frombuffer(row["image"], np.uint8).reshape(side, side), row


def test_line_covers_pixels_by_distance():
    got = render.rasterise(pa.array([[0.0, 16.0, 64.0, 16.0]]), 64, 3.0, 64.0)[0]
    # The line lies between rows 15 and 16: three pixels wide, it covers two whole and half of the next ones.
    assert list(got[:, 30]) == [0] * 14 + [128, 255, 255, 128] + [0] * 46


def test_thin_lines_cover_no_more_than_their_width():
    got = render.rasterise(pa.array([[0.0, 16.5, 64.0, 16.5]]), 64, 0.4, 64.0)[0]
    assert list(got[14:19, 30]) == [0, 0, 102, 0, 0]


def test_circle_is_a_ring(spark):
    got, row = image(spark, f'{HEAD}<circle cx="150" cy="150" r="100"/></svg>', 128, 9.0)
    y, x = np.mgrid[0:128, 0:128] + 0.5
    d = np.abs(np.hypot(x - 64, y - 64) - 100 * 128 / 300)
    w = 9.0 * 128 / 300
    want = np.clip(w / 2 + 0.5 - d, 0, min(w, 1)) * 255
    assert np.abs(got - want).max() < 26 and row["n_ink"] == (got >= render.INK).sum() and row["level_sum"] == int(got.sum())


def test_transforms_and_view_box_apply(spark):
    a, _ = image(spark, f'{HEAD}<path d="M20 20L200 90"/></svg>')
    b, _ = image(spark, '<svg viewBox="0 0 30 30"><g transform="translate(1 1)"><path d="M1 1L19 8"/></g></svg>')
    assert (a == b).all() and a.any()


def test_slices_do_not_change_images(monkeypatch):
    rng = np.random.default_rng(1)
    column = pa.array([None if i % 7 == 3 else list(rng.uniform(-50, 350, 4 * int(rng.integers(0, 9)))) for i in range(40)] + [[math.nan, 0.0, 1.0, 1.0]])
    whole = render.rasterise(column, 32, 5.0)
    assert not whole[3].any() and not whole[40].any()
    monkeypatch.setattr(render, "PIXELS", 100)
    assert (render.rasterise(column, 32, 5.0) == whole).all() and (render.rasterise(column.slice(5, 20), 32, 5.0) == whole[5:25]).all()


def test_similarity_equals_the_window_by_window_one():
    rng = np.random.default_rng(2)
    a, b = rng.random((3, 20, 20)), rng.random((3, 20, 20))
    want = [evaluation.ssim_pair(x, y) for x, y in zip(a, b)]
    assert np.allclose(render.ssim(a, b), want) and np.allclose(render.ssim(a, a), 1)


def test_documents_that_cannot_be_rendered(spark):
    good, bad = f'{HEAD}<path d="M20 20L200 90"/></svg>', "<svg"
    df = spark.createDataFrame([(1, good, good), (2, good, bad), (3, None, good)], "k int, a string, b string")
    rows = render.with_similarity(render.document_lines(df, x="a", y="b"), "x", "y", 32).collect()
    got = {r["k"]: r["render_ssim"] for r in rows}
    assert got[1] == pytest.approx(1) and got[2] == 0
    with pytest.raises(Exception, match="can't be rendered"):
        render.with_image(render.document_lines(df.filter("k = 2"), strict=True, z="b").select("z"), "z", 32).collect()
    assert render.with_image(df.limit(0).select(F.lit(None).cast("array<double>").alias("z")), "z").count() == 0


def test_scene_scores_with_and_without_images(spark):
    docs = spark.createDataFrame([(1, f'{HEAD}<path d="M20 20L200 90"/><rect x="30" y="40" width="99" height="77"/></svg>')], "doc_id int, svg string")
    assert evaluation.builtin_eval(docs).first()["render_ssim"] is None
    assert 0.5 < evaluation.builtin_eval(docs, side=128).first()["render_ssim"] < 1


def test_long_paths_are_scanned_in_blocks(spark):
    d = "M 1 1 " + " ".join(f"l {(-1) ** i * (i % 7)} {(-1) ** (i // 3) * (i % 5)} t 1 -1" if i % 3 else "L 150 150 z m 3 2" for i in range(6000))
    rows = codec.tokenize(spark.createDataFrame([(f'{HEAD}<path d="{d}"/></svg>',)], "svg string"))
    row = codec.detokenize(rows.select("token_ids", "tokenizer_version")).first()
    n = sum(2 if i % 3 else 3 for i in range(6000)) + 1
    assert rows.first()["n_commands"] == n and row["valid"] and row["svg"].count("Z") == 2000


def test_a_slice_is_small_in_memory():
    """What a slice of images takes at its fullest is bounded well below a worker's share."""
    import tracemalloc

    lines = pa.array([[0.0, 0.0, 300.0, 300.0, 300.0, 0.0, 0.0, 300.0]] * (render.PIXELS // 64**2), pa.list_(pa.float64()))
    tracemalloc.start()
    try:
        images = render.rasterise(lines, 64, 5.0)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 100 << 20 and (images == images[0]).all()
