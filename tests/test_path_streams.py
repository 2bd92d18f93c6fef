import random

import pyarrow as pa
from pyspark.sql import functions as F

from strokeforge.functions import decode, grammar, ids
from strokeforge.operators import detok

STREAM = "i int, t array<int>, canvas double"


def streams(seed, n):
    """Streams of any kind: sound ones, and ones with tokens left out, doubled, out of place or of shapes."""
    r = random.Random(seed)
    coord = lambda: r.choice([r.randrange(100, ids.VOCAB), r.randrange(ids.level_base(6), ids.VOCAB)])
    out = [None, [], [1], [1, 2], [1, 3, 2], [1, 10, 3, 2000, 2], [2, 1, 10, 200], [200, 10, 300, 2, 400]]
    while len(out) < n:
        t = [1]
        for _ in range(r.randrange(7)):
            k = r.choice([10, 11, 11, 12, 13, 14, 15, 16, 17, 3, 20 if r.random() < 0.2 else 11])
            t += [k, *(coord() for _ in range((grammar.ARGS | {3: 0})[k] + (r.randrange(-1, 2) if r.random() < 0.1 else 0)))]
            if r.random() < 0.3:
                t += r.choice([[30], [31, 45], [40], [33, 45, 46], [30, 31]])
        t.append(2)
        for _ in range(r.randrange(3) if r.random() < 0.3 else 0):
            i = r.randrange(len(t))
            t[i : i + 1] = r.choice([[], [t[i], t[i]], [coord()], [2], [1], [3], [66], [9], [61]])
        out.append(t)
    return [(i, t, r.choice([300.0, 100.0, 33.3, 24.0, 7.1])) for i, t in enumerate(out)]


def test_streams_of_paths_decode_as_the_fold_decodes_them(spark):
    rows = streams(4, 1500)
    df = spark.createDataFrame(rows, STREAM).repartition(3)
    for canvas in ("canvas", 300):
        out = detok.with_elements(df, "t", "e", canvas, 6).withColumn("was", F.expr(f"IF(t IS NULL OR exists(t, t -> t >= 60 AND t < 71), e, {decode.element_list('t', canvas, 6)})"))
        assert out.filter("NOT (e <=> was)").limit(3).collect() == []
        assert out.filter(F.expr(detok.path_only("t"))).count() > 900


def test_paths_are_made_without_the_fold():
    t = pa.array([[1, 10, 1595, 11, 5430, 3, 17, 2], [1, 2]], pa.list_(pa.int32()))
    style = decode.STYLE
    assert detok.drawn_paths(t, [300.0, 300.0]).to_pylist() == [[f'<path d="M 11.7 11.7 L 288.3 288.3" {style}/>', f'<path d="Z" {style}/>'], ['<path d="" fill="none" stroke="black" stroke-width="1.0"/>']]


def test_valid_as_by_validation(spark):
    df = spark.createDataFrame(streams(5, 1500), STREAM).select("t", F.expr(grammar.is_valid("t")).alias("a"), F.expr(f"({grammar.validated('t')}).valid").alias("b"))
    # Not by way of the fold alone: what is held against it is the fold's verdict, for sound and unsound streams.
    assert df.filter("NOT (a <=> b)").limit(3).collect() == []
    assert df.filter("a").count() > 300 and df.filter("NOT a").count() > 300
