import random

import pytest
from pyspark.sql import functions as F

from strokeforge.functions import ids
from strokeforge.operators import codec, long_paths
from test_functions import ICON


def commands(seed, n):
    r = random.Random(seed)
    at = lambda k: " ".join(str(r.randrange(3000) / 10) for _ in range(2 * k))
    return ["M " + at(1)] + [r.choice([f"L {at(1)}", f"C {at(3)}", f"Q {at(2)}", f"M {at(1)}", "Z"]) for _ in range(n - 1)]


def test_pieces_are_the_whole_path(spark, monkeypatch):
    monkeypatch.setattr(long_paths, "PIECE", 7)
    paths = {"a": commands(1, 100), "b": commands(2, 7), None: commands(3, 30)}
    rows = spark.createDataFrame([(k, 10 * i + 3, c) for k, v in paths.items() for i, c in enumerate(v)], "k string, o int, c string").repartition(5)
    out = long_paths.started(long_paths.decoded(long_paths.encoded(long_paths.pieces(long_paths.numbered(rows, "k", "o"), "k", "c"))), "k").collect()
    for k, v in paths.items():
        own = sorted((r for r in out if r.k == k), key=lambda r: r.part)
        assert [r.part for r in own] == list(range(-(-len(v) // 7))) and [r["first"] for r in own] == [7 * r.part for r in own]
        svg = ICON.replace("viewBox=\"0 0 24 24\"", "").replace("M12 2 L22 7 L12 12 Z", " ".join(v))
        whole = codec.tokenize(spark.createDataFrame([(svg,)], "svg string"), lean=True).first().token_ids
        assert [1, *(t for r in own for t in r.body), 2] == whole
        assert [r.start for r in own] == [1 + sum(len(q.body) for q in own[:i]) for i in range(len(own))]
        back = codec.detokenize(spark.createDataFrame([(whole, ids.TOKENIZER_VERSION)], "token_ids array<int>, tokenizer_version string")).first()
        assert all(r.valid for r in own) and f' d="{" ".join(r.d_decoded for r in own)}"' in back.svg


def test_no_task_takes_a_whole_path(spark):
    rows = spark.range(3000).select(F.lit("k").alias("k"), "id", F.expr("concat(IF(id = 0, 'M', 'L'), ' ', id % 300, ' 5')").alias("c"))
    sizes = [len(x) for x in long_paths.pieces(long_paths.numbered(rows, "k", "id"), "k", "c").select("part").rdd.glom().collect()]
    assert sum(sizes) == 12 and max(sizes) < 12


def test_relative_commands_are_refused_and_nothing_gives_nothing(spark):
    rows = spark.createDataFrame([("a", 0, "M 1 1"), ("a", 1, "l 1 1")], "k string, o int, c string")
    run = lambda rows: long_paths.encoded(long_paths.pieces(long_paths.numbered(rows, "k", "o"), "k", "c")).collect()
    assert run(rows.limit(0)) == []
    with pytest.raises(Exception, match="absolute commands"):
        run(rows)
