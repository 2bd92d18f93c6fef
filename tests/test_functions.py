import math

import pytest
from pyspark.sql import functions as F

from strokeforge.functions import curves, decode, grammar, ids, path, relations, shapes, tokens
from strokeforge.operators import codec

SVG = "doc_id int, svg string"
ICON = '<svg xmlns="http://www.w3.org/2000/svg" width="24" height="24" viewBox="0 0 24 24"><path d="M12 2 L22 7 L12 12 Z"/></svg>'


def one(spark, sql, **cols):
    df = spark.range(1).select(*[F.expr(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(F.expr(sql).alias("x")).first()["x"]


def encode(spark, svg, **how):
    return codec.tokenize(spark.createDataFrame([(1, svg)], SVG), **how).first()


def test_ids_and_points(spark):
    for x, y, want in ((10, 10, 1595), (290, 290, 5430), (-5, 400, 5497)):
        assert one(spark, ids.coord_id(f"{x}D", f"{y}D")) == want
    assert ids.VOCAB == 5561 and ids.level_base(6) == 1465
    assert one(spark, ids.coord_id("double('NaN')", "double('Infinity')")) == one(spark, ids.coord_id("0D", "300D"))


@pytest.mark.parametrize("v,code", [(20, 273), (15, 205), (40, 546), (150, 2048), (0, 0), (300, 4095), (-1, 0), (900, 4095)])
def test_scalar_codes(spark, v, code):
    assert one(spark, ids.scalar_code(f"{v}D")) == code
    assert one(spark, ids.code_of(ids.scalar_id(f"{v}D"))) == code


def test_scalars_come_back_within_their_bound(spark):
    for v in (0, 0.07, 1, 20, 37.5, 50, 149.97, 299.9):
        assert abs(one(spark, ids.scalar_of(ids.scalar_id(f"{v}D"))) - v) <= ids.scalar_bound() + 1e-9
    assert one(spark, ids.scalar_code("double('NaN')")) == 0 and one(spark, ids.scalar_code("double('Infinity')")) == 0


def test_counts_are_lossless(spark):
    assert one(spark, f"forall(sequence(0, 4095), n -> {ids.code_of(ids.count_id('n'))} = n)")


def test_coordinates_decode_to_their_cells(spark):
    assert one(spark, f"forall(sequence(100, 5560), t -> {ids.level_of('t')} IS NOT NULL)")
    for level in range(7):
        back = ids.coord_id(ids.x_of("t"), ids.y_of("t"), level)
        lo, hi = ids.level_base(level), ids.level_base(level + 1) - 1
        assert one(spark, f"forall(sequence({lo}, {hi}), t -> {back} = t)")


def test_reserved_ids(spark):
    for t in (5, 9, 18, 25, 35, 57, 71, 79, 99):
        assert one(spark, ids.kind(str(t))) == "unknown" and one(spark, ids.symbol(str(t))) == f"?{t}"
    assert one(spark, ids.symbol("5600", 5561)) == "MERGE@5600" and one(spark, ids.symbol("42")) == "CURV@2" and one(spark, ids.symbol("1595")) == "C6:2,2"


def commands(spark, d):
    return [(k.c, list(k.p)) for k in one(spark, path.parsed("d"), d=f"'{d}'")]


def test_path_grammar(spark):
    assert commands(spark, "M 10 20 30 40") == [("M", [10, 20]), ("L", [30, 40])]
    assert commands(spark, "M0 0 A5 5 0 0110 10")[1] == ("A", [5, 5, 0, 0, 1, 10, 10])
    assert commands(spark, "m1-2.5e1.5.5") == [("M", [1, -25]), ("L", [1.5, -24.5])]
    assert commands(spark, "m1 2 3 4h5v6z l1 1") == [("M", [1, 2]), ("L", [4, 6]), ("H", [9, 6]), ("V", [9, 12]), ("Z", []), ("L", [2, 3])]
    assert commands(spark, "M0 0C1 1 2 2 3 3S5 5 6 6")[2] == ("C", [4, 4, 5, 5, 6, 6])
    assert commands(spark, "M0 0C1 1 2 2 3 3T6 6")[2] == ("Q", [4, 4, 6, 6])
    assert commands(spark, "M0 0S1 1 2 2")[1] == ("C", [0, 0, 1, 1, 2, 2])
    assert commands(spark, "M1 1L2") == [("M", [1, 1])] and commands(spark, "") == []


def test_transforms(spark):
    m = one(spark, path.transform_matrix("array('translate(10,20)', NULL, 'rotate(90) scale(2)', 'skewX(45)')"))
    assert [round(v, 9) for v in m] == [0, 2, -2, 2, 10, 20]
    m = one(spark, path.transform_matrix("array('rotate(90 5 5) unknown(3) matrix(1 0)')"))
    assert [round(v, 9) for v in m] == [0, 1, -1, 0, 10, 0]


def test_document_front_end(spark):
    svg = '<svg width="300" height="300"><defs><rect width="9" height="9"/></defs><g transform="translate(10 0)"><g id="a" transform="scale(2)"><line x1="1" y1="2" x2="3" y2="4" transform="translate(1,1)" fill="red"/></g></g><polygon points="1,2 3"/></svg>'
    r = codec.parsed(spark.createDataFrame([(1, svg)], SVG)).first()
    assert [(k.c, list(k.p)) for k in r.elements[0]] == [("M", [14, 6]), ("L", [18, 10])] and list(r.elements[1]) == []
    assert r.doc.elements[0].gid == "a" and r.doc.elements[0].attributes == {"fill": "red"}
    t = encode(spark, svg)
    assert t.n_elements == 1 and t.normalization.transforms_flattened == 1


@pytest.mark.parametrize("svg,code", [("<svg><rect", "PARSE_ERROR"), ('<svg><rect width="10px"/></svg>', "PARSE_ERROR"), ("<svg><text/></svg>", "PARSE_UNSUPPORTED_ELEMENT"), ('<svg><filter/></svg>', "PARSE_UNSUPPORTED_ELEMENT"), ("<svg>" + " " * 262144 + "</svg>", "PAYLOAD_TOO_LARGE")])
def test_errors(spark, svg, code):
    assert encode(spark, svg).error.code == code


def test_comments_are_no_markers(spark):
    assert encode(spark, "<svg><!-- <text> --><desc><use/></desc></svg>").error is None


def test_tokens(spark):
    assert list(encode(spark, '<svg width="300" height="300"><path d="M 10 10 L 290 290"/></svg>').token_ids) == [1, 10, 1595, 11, 5430, 2]
    icon = '<svg viewBox="0 0 24 24"><path d="M12 2 L22 7 L12 12 Z"/><circle cx="12" cy="17" r="3"/></svg>'
    full, lean = encode(spark, icon), encode(spark, icon, lean=True)
    assert list(lean.token_ids) == [t for t in full.token_ids if not (30 <= t < 34 or 40 <= t < 56)]
    assert full.n_elements == 2 and 3 in full.token_ids and full.n_tokens == len(full.token_ids)
    assert encode(spark, icon, level="L9").warnings == ["unknown level 'L9'; emitting L1"]
    assert "clamped" in encode(spark, '<svg><path d="M-5 0L400 1"/></svg>').warnings[0]


STREAMS = {
    (1, 2): (True, -1), (1, 10, 140, 11, 141, 2): (True, -1), (10, 140, 2): (False, 0), (1, 14, 140, 2): (False, 3), (1, 2, 10): (False, 1), (1, 10, 11, 2): (False, 2),
    (): (False, 0), (1, 10, 140): (False, 2), (1, 10, 140, 1): (False, 3), (1, 10, 140, 31, 42, 17, 2): (True, -1), (1, 10, 140, 42, 31, 2): (False, 4), (1, 20, 140, 2000, 30, 2): (False, 4), (1, 66, 3, 2): (True, -1),
}


def brute_repair(ids_):
    """Keep what validates as a prefix; cut to the last complete group."""
    out, pending, args = [1], 0, grammar.ARGS
    state, on_path, whole = 0, False, 1
    for t in ids_[1:] if ids_[:1] == [1] else ids_:
        if t == 2:
            break
        edge = 10 <= t < 18 or 20 <= t < 24 or 60 <= t < 71 or t in (2, 3)
        ok = 100 <= t < 5561 if pending else edge or (state == 2 and on_path and (30 <= t < 34 or 40 <= t < 56)) or (state == 3 and 40 <= t < 56)
        if t == 1 or not ok:
            continue
        out.append(t)
        if pending:
            pending -= 1
            state = 2 if pending == 0 else 1
        elif t in args:
            pending, on_path = args[t], 10 <= t < 18
            state = 1 if pending else 2 if 10 <= t < 18 else 0
        elif 30 <= t < 34:
            state = 3
        else:
            state, on_path = 0, on_path and t != 3
        if pending == 0:
            whole = len(out)
    return [*out[:whole], 2]


def test_grammar(spark):
    df = spark.createDataFrame([(i, list(t)) for i, t in enumerate(STREAMS)], "i int, t array<int>")
    rows = {r.i: r for r in df.select("i", F.expr(grammar.validated("t")).alias("v"), F.expr(grammar.repaired("t")).alias("r")).collect()}
    for i, (t, want) in enumerate(STREAMS.items()):
        assert (rows[i].v.valid, rows[i].v.position) == want, t
        assert list(rows[i].r) == brute_repair(list(t))
    again = spark.createDataFrame([(list(r.r),) for r in rows.values()], "t array<int>").select(F.expr(f"({grammar.validated('t')}).valid").alias("v"))
    assert all(r.v for r in again.collect())
    assert one(spark, grammar.repaired("array(14,140,999,2,2)")) == [1, 2]


def test_decoding(spark):
    rows = {1: [1, 20, 3545, 2557, 2], 2: [1, 20, 3519, 2300, 66, 60, 1497, 64, 3649, 70, 1849, 2], 3: [1, 2], 4: [1, 10, 1595, 11, 5430, 3, 10, 1595, 17, 2], 5: [1, 20, 3545, 150, 2], 6: [1, 20, 2819, 2557, 62, 1497, 2], 7: [1, 12, 1595, 13, 1595, 16, 1595, 5430, 2]}
    df = spark.createDataFrame(list(rows.items()), "i int, token_ids array<int>").withColumn("tokenizer_version", F.lit(ids.TOKENIZER_VERSION))
    got = {r.i: r.svg.split("\n")[1:-1] for r in codec.detokenize(df).collect()}
    assert '<circle cx="152.34" cy="152.34" r="20" ' in got[1][0]
    assert len(got[2]) == 7 and 'cx="270.5" cy="152.3" r="15"' in got[2][-1]
    assert got[3] == ['  <path d="" fill="none" stroke="black" stroke-width="1.0"/>']
    assert [x.count("<path") for x in got[4]] == [1, 1] and "M 11.7 11.7 L 288.3 288.3" in got[4][0] and "M 11.7 11.7 Z" in got[4][1]
    assert got[5] == ['  <path d="" fill="none" stroke="black" stroke-width="1.0"/>']
    assert len(got[6]) == 2 and 'cx="250.9' in got[6][1]
    assert 'd="H 11.7 V 11.7 A 11.7 11.7 0 0 1 288.3 288.3"' in got[7][0]


@pytest.mark.parametrize("version,vocab,tokens_,code", [(None, None, [1, 2], "VERSION_REQUIRED"), ("x", None, [1, 2], "VOCAB_MISMATCH"), (ids.TOKENIZER_VERSION, "x", [1, 2], "VOCAB_MISMATCH"), (ids.TOKENIZER_VERSION, ids.VOCAB_ID, [1, 5561, 2], "VOCAB_MISMATCH"), (ids.TOKENIZER_VERSION, None, [1, 2], None), ("another-writer-1.0.0", None, [1, 2], None), ("strokeforge-2.0.0", None, [1, 2], "VOCAB_MISMATCH")])
def test_pins(spark, version, vocab, tokens_, code):
    df = spark.createDataFrame([(version, vocab, tokens_)], "tokenizer_version string, vocab_id string, token_ids array<int>")
    err = codec.detokenize(df).first().error
    assert (err.code if err else None) == code


def test_curvature_of_a_circle(spark):
    k = 100 * path.KAPPA
    quarter = path.cmd("C", ["100D", f"{k}D", f"{k}D", "100D", "0D", "100D"], "100D", "0D", "0D", "100D")
    g = one(spark, f"element_at(transform(array({quarter}), k -> {curves.segment()}), 1)")
    assert abs(g.kmax - 0.01) < 1e-4 and abs(g.len - 50 * math.pi) < 0.1 and abs(g.t0 - math.pi / 2) < 1e-9 and not g.straight
    assert one(spark, curves.curvature_bin("0.01D")) == 2


def test_shapes_and_relations(spark):
    def stream(svg):
        df = codec.parsed(spark.createDataFrame([(1, svg)], SVG))
        df = df.withColumn("b", F.expr(f"transform(elements, e -> {shapes.composite('e')})")).withColumn("info", F.expr(f"transform(elements, (e, n) -> {shapes.info('e', 'n')})"))
        r = df.select(F.expr(relations.relations("info")).alias("r"), F.expr(relations.stream("b", "info")).alias("t"), F.expr(f"flatten(transform(elements, e -> {shapes.detected('e')}))").alias("s")).first()
        return [x.kind for x in r.r], list(r.t), [x.shape for x in r.s]

    circle = lambda x, y, r=20: f'<circle cx="{x}" cy="{y}" r="{r}"/>'
    kinds, t, s = stream("<svg>" + "".join(circle(30 + 40 * i, 150, 15) for i in range(7)) + "</svg>")
    assert t == [1, 20, 3519, 2300, 66, 60, 1497, 64, 3649, 70, 1849, 2] and s == ["circle"] * 7 and "EQUAL_SPACE_H" in kinds
    kinds, t, _ = stream("<svg>" + circle(50, 100) + circle(250, 100) + "</svg>")
    assert "SYM_REFLECT_X" in kinds and t[-3:] == [62, 1497, 2] and t.count(20) == 1
    kinds, t, _ = stream("<svg>" + circle(50, 100) + circle(170, 230, 60) + "</svg>")
    assert kinds == [] and t.count(20) == 2 and t.count(3) == 1
    _, _, s = stream('<svg><rect x="10" y="20" width="200" height="150" rx="20"/><path d="M10 10L100 10L60 90Z"/><ellipse cx="150" cy="150" rx="120" ry="80"/><rect x="1" y="2" width="30" height="40"/></svg>')
    assert s == ["round_rect", "ellipse", "rect"]


def test_markers_do_not_change_what_is_decoded(spark):
    svg = '<svg viewBox="0 0 100 100"><path d="M10 10C20 20 40 20 50 10S80 0 90 50q-10 20 -30 10t-20 5Z"/></svg>'
    docs = [list(encode(spark, svg, lean=x).token_ids) for x in (False, True)]
    df = spark.createDataFrame([(t,) for t in docs], "token_ids array<int>")
    out = {r.d for r in df.select(F.expr(decode.document(decode.element_list("token_ids"))).alias("d")).collect()}
    assert len(docs[0]) > len(docs[1]) and len(out) == 1
    assert list(df.select(F.expr(tokens.lean_of("token_ids")).alias("t")).first().t) == docs[1]


def test_tokens_are_made_without_measuring_segments():
    """Curvature markers need neither the length nor the mean of a curve, each of which costs dozens of samples."""
    from strokeforge.functions import curves, tokens

    assert curves.length() in curves.analysed("elements[0]")
    assert curves.length() not in tokens.full("elements[0]")
