import pytest

from strokeforge.errors import EngineError
from strokeforge.functions import ids
from strokeforge.operators import bpe, codec, configured, manifest, service

SVG = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 50 100"><path d="M 10 20 L 30 40 C 1 2 3 4 50 60"/><rect x="1" y="2" width="80" height="9"/></svg>'
MERGES = [[11, 289, 441], [441, 14, 442]]


def table(spark, *manifests):
    return manifest.stored(spark, list(manifests)).select("vocab_id", "manifest")


def test_the_default_configuration_gives_what_the_codec_gives(spark):
    docs = spark.createDataFrame([(1, None, SVG), (2, ids.VOCAB_ID, "<svg><path d='M0 0L900 900'/></svg>"), (3, None, "<svg>"), (4, None, None)], "k int, vocab_id string, svg string")
    c = configured.load(table(spark, manifest.build()))
    for lean in (False, True):
        a, b = configured.tokenize(docs, c, "L3", lean).orderBy("k"), codec.tokenize(docs, "L3", lean).orderBy("k")
        assert a.drop("content_hash").select(b.columns).collect() == b.collect()
    streams = a.select("k", "token_ids", "tokenizer_version", "vocab_id")
    back, plain = configured.detokenize(streams, c).orderBy("k"), codec.detokenize(streams).orderBy("k")
    assert back.select("k", "svg", "valid", "repaired", "n_tokens", "error").collect() == plain.select("k", "svg", "valid", "repaired", "n_tokens", "error").collect()
    assert [r.content_hash for r in a.collect()] == [manifest.content_hash(manifest.build())] * 4


def test_rows_of_several_manifests(spark):
    small, other = manifest.build(vocab_id="small", canvas=100, level=4), manifest.build(MERGES, "merged", 100, 4)
    assert (small["vocab_size"], len(small["level_layout"]), other["merge_base_id"]) == (441, 5, 441)
    docs = spark.createDataFrame([(i, v, SVG) for i, v in enumerate([None, "small", "merged"])], "k int, vocab_id string, svg string")
    c = configured.load(table(spark, manifest.build(), small, other))
    rows = {r.k: r for r in configured.tokenize(docs, c, "L2").collect()}
    assert [rows[k].level for k in range(3)] == ["L1", "L1", "L2"] and [len(rows[k].warnings) for k in range(3)] == [2, 2, 1]
    assert rows[2].token_ids == bpe.encode_stream(rows[1].token_ids, {(a, b): i for i, (a, b, _) in enumerate(MERGES)}, 441) != rows[1].token_ids
    assert "MERGE@442" in rows[2].tokens and all(t < 441 for t in rows[1].token_ids)
    there = configured.tokenize(docs, c, "L2").select("k", "vocab_id", "token_ids", "tokenizer_version")
    back = {r.k: r for r in configured.detokenize(there, c).collect()}
    assert back[1].svg == back[2].svg != back[0].svg and 'viewBox="0 0 100 100"' in back[1].svg and back[1].fidelity.canvas == 100
    # An id of one vocabulary is out of another's range.
    mixed = spark.createDataFrame([("small", [1, 10, 441, 2]), ("merged", [1, 10, 200, 442, 2]), (None, [1, 10, 441, 2])], "vocab_id string, token_ids array<int>").selectExpr("*", f"'{ids.TOKENIZER_VERSION}' AS tokenizer_version")
    got = {r.vocab_id: r.error for r in configured.detokenize(mixed, c).collect()}
    assert got["small"].message == "token id 441 out of range [0,441)" and got["merged"] is None and got[ids.VOCAB_ID] is None


def test_shapes_and_reflections_have_the_rows_level_and_canvas(spark):
    scalar = lambda code, level: ids.level_base(level) + code % 2**level * 2**level + code // 2**level
    # A circle of radius canvas / 5 in the first cell, mirrored at the middle of the canvas (code 51 of 255, and 128 of 255).
    stream = [1, 20, ids.level_base(4), scalar(51, 4), 62, scalar(128, 4), 2]
    rows = spark.createDataFrame([("a", stream), ("b", stream)], "vocab_id string, token_ids array<int>").selectExpr("*", f"'{ids.TOKENIZER_VERSION}' AS tokenizer_version")
    c = configured.load(table(spark, manifest.build(vocab_id="a", canvas=255, level=4), manifest.build(vocab_id="b", canvas=510, level=4)))
    got = {r.vocab_id: r.svg for r in configured.detokenize(rows, c).collect()}
    assert 'cx="7.97" cy="7.97" r="51"' in got["a"] and 'cx="248" cy="8" r="51"' in got["a"]
    assert 'cx="15.94" cy="15.94" r="102"' in got["b"] and 'cx="496.1" cy="15.9" r="102"' in got["b"]


def test_manifests_that_cannot_be_used(spark):
    bad = [("text", "{"), ("null", None), ("list", "[]"), ("flat", '{"canvas_size": 0, "max_coord_level": 3}'), ("deep", '{"canvas_size": 9, "max_coord_level": 7}'), ("gap", '{"canvas_size": 9, "max_coord_level": 6, "merges": [[10, 11, 5562]]}')]
    c = configured.load(spark.createDataFrame([*bad, (None, "{}")], "vocab_id string, manifest string"))
    docs = spark.createDataFrame([(v, SVG) for v, _ in bad] + [(None, SVG), ("none", SVG)], "vocab_id string, svg string")
    out = configured.tokenize(docs, c).collect()
    assert {r.error.code for r in out} == {"INVALID_REQUEST"} and all(r.token_ids is None for r in out)
    assert {r.vocab_id: r.error.message for r in out}["none"] == "unknown vocab_id none"
    with pytest.raises(EngineError, match="several"):
        configured.load(table(spark, manifest.build(), manifest.build(canvas=10)))
    assert configured.load(table(spark, manifest.build(), manifest.build())).table.count() == 1
    with pytest.raises(EngineError, match="more than"):
        configured.load(spark.range(configured.MOST + 1).selectExpr("cast(id AS STRING) AS vocab_id", "'{}' AS manifest"))
    empty = configured.load(spark.createDataFrame([], "vocab_id string, manifest string"))
    assert configured.tokenize(docs.limit(0), empty).count() == 0 and configured.tokenize(docs, empty).filter("error IS NULL").count() == 0


def test_items_of_a_batch_by_configuration(spark):
    c = configured.load(table(spark, manifest.build(), manifest.build(MERGES, "merged", 100, 4)))
    items = spark.createDataFrame(
        [("1", None, None, SVG, None, "L2"), ("2", "merged", None, SVG, None, "L2"), ("3", "merged", None, None, [1, 10, 120, 442, 2], None), ("4", "merged", None, None, [1, 443, 2], None), ("5", "none", None, SVG, None, None), ("6", "merged", "paint", SVG, None, None)],
        "id string, vocab_id string, op string, svg string, token_ids array<int>, level string",
    )
    got = {r.id: r for r in service.process(items, configs=c).collect()}
    assert [got[k].ok for k in "123456"] == [True, True, True, False, False, False]
    assert (got["1"].level, got["2"].level) == ("L1", "L2") and "100" in got["3"].svg
    assert got["4"].error.detail == {"max_id": "443"} and got["5"].error.status == 400 and got["6"].error.message == "unknown op 'paint'"
