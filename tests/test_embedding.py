import numpy as np
import pytest

from strokeforge.errors import EngineError
from strokeforge.functions import ids
from strokeforge.operators import embedding


@pytest.fixture(scope="module")
def weights(spark):
    return {v: {r.token_id: np.array(r.weight) for r in embedding.initial(spark, 32, v).collect()} for v in (1, 2)}


def cosine(a, b):
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_every_id_has_weights_and_padding_has_none(weights):
    for rows in weights.values():
        assert sorted(rows) == list(range(ids.VOCAB)) and not rows[0].any()
        assert all(len(w) == 32 and np.isfinite(w).all() and (t == 0 or w.any()) for t, w in rows.items())


def test_norms_of_the_second_version_are_one(weights):
    assert np.allclose([np.linalg.norm(w) for t, w in weights[2].items() if t], 1)


def test_ordered_ids_lie_on_a_ramp(weights):
    w = weights[1]
    for first, last in ((30, 33), (40, 55)):
        step = w[first + 1] - w[first]
        assert np.allclose([w[t + 1] - w[t] for t in range(first, last)], step) and np.linalg.norm(step) > 0
        far = [np.linalg.norm(w[t] - w[first]) for t in range(first, last + 1)]
        assert far == sorted(far)


def test_ids_of_one_meaning_are_nearer_than_others(weights):
    w = weights[1]
    for a, b, other in ((11, 12, 14), (14, 15, 11), (20, 21, 22), (60, 61, 62)):
        assert cosine(w[a], w[b]) > cosine(w[a], w[other])


def test_near_cells_are_more_alike(weights):
    w, base = weights[2], ids.level_base(6)
    alike = [cosine(w[base + 64 * 32 + 20], w[base + 64 * 32 + 20 + step]) for step in (1, 8)]
    assert alike[0] > alike[1]


def test_reruns_and_splits_agree(spark, weights):
    again = embedding.initial(spark, 32).repartition(7).filter("token_id % 100 = 11").collect()
    assert again and all(np.array_equal(r.weight, weights[1][r.token_id]) for r in again)


@pytest.fixture(scope="module")
def small(spark):
    return embedding.model(embedding.initial(spark, 8), 4, 6)


def test_forward_is_normal_and_knows_positions(spark, small):
    docs = [(1, [1, 10, 140, 2]), (2, None), (3, []), (4, [140, 140]), (5, [-5, 99999, None])]
    got = {r.id: r.embedding for r in embedding.forward(spark.createDataFrame(docs, "id long, token_ids array<int>").repartition(1), small).collect()}
    assert got[2] is None and got[3] == [] and [len(v) for v in got[1]] == [8] * 4
    y = np.array(got[1])
    assert np.allclose(y.mean(1), 0) and np.allclose(y.var(1), 1, atol=1e-2)
    assert got[4][0] != got[4][1]  # one id at two places
    want = embedding.normalised(embedding.projected(small, np.array([0, ids.VOCAB - 1, 0])) + embedding.waves(np.arange(3), 8))
    assert np.allclose(got[5], want)


def test_long_streams_come_in_parts(spark, small, monkeypatch):
    docs = spark.range(50).selectExpr("id", "cast(transform(sequence(1, 1 + cast(id AS INT) * 3), i -> 100 + i) AS ARRAY<INT>) AS token_ids").coalesce(1)
    whole = {r.id: r.embedding for r in embedding.forward(docs, small).collect()}
    one = docs.filter("id = 49")
    assert np.allclose(embedding.forward(one, small).first().embedding, whole[49]) and len(whole[0]) == 1
    assert {k: len(v) for k, v in whole.items()} == {i: 1 + 3 * i for i in range(50)}


def test_other_ids_have_no_place(small):
    kind, place = embedding.features(np.array([0, 10, 20, 31, 41, 65, 100, ids.VOCAB - 1]))
    assert kind.tolist() == [0, 1, 2, 3, 4, 5, 6, 6] and not place[:6].any()
    assert np.allclose(place[6], [0, 0.5, 0.5]) and np.allclose(place[7], [1, 63.5 / 64, 63.5 / 64])


def test_a_model_beyond_the_bound_is_refused(spark, small, monkeypatch):
    monkeypatch.setattr(embedding, "MOST_BYTES", 1000)
    with pytest.raises(EngineError):
        embedding.forward(spark.createDataFrame([(1, [1])], "id long, token_ids array<int>"), small)
    with pytest.raises(EngineError):
        embedding.model(embedding.initial(spark, 8), 4, 6)
