import json

from strokeforge.streaming import ndjson

SVG = '<svg viewBox="0 0 10 10"><path d="M1 1L2 2"/></svg>'


def test_batches_without_new_ids_are_not_processed(spark, tmp_path, monkeypatch):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    asked, results = [], ndjson.results
    monkeypatch.setattr(ndjson, "results", lambda kept: asked.append(1) or results(kept))
    line = lambda i: json.dumps({"id": i, "op": "tokenize", "svg": SVG}) + "\n"

    def run(name, ids):
        (tmp_path / "in" / name).write_text("".join(map(line, ids)))
        ndjson.write_once(ndjson.read_numbered(spark, src), out, state).awaitTermination()
        return sorted(r.id for r in spark.read.schema("id string").json(out).collect()), len(asked)

    assert run("a.json", "abab") == (["a", "b"], 1)
    assert run("b.json", "ba") == (["a", "b"], 1)  # nothing but repeats
    assert run("c.json", "cbc") == (["a", "b", "c"], 2)
    assert run("d.json", "c") == (["a", "b", "c"], 2)  # the state of the batches before was kept


def test_a_first_batch_without_lines_leaves_an_empty_result(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n \n")
    ndjson.write_once(ndjson.read_numbered(spark, src), out, state).awaitTermination()
    assert spark.read.schema("id string").json(out).count() == 0
