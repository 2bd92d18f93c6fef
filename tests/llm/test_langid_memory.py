import tracemalloc

import numpy as np

from strokeforge.llm import langid


def test_building_a_model_takes_little_beside_its_tables():
    # The driver builds it, whose memory is bounded however many contexts the sample has.
    rng = np.random.default_rng(5)
    words = [rng.integers(97, 97 + 26, rng.integers(2, 9), np.uint8).tobytes() for _ in range(6000)]
    sample = {lang: [b" ".join(words[i] for i in rng.integers(0, 6000, 350)) for _ in range(400)] for lang in "abcd"}
    for dense_bytes in (langid.DENSE_BYTES, 0):
        tracemalloc.start()
        m = langid.Model(sample, dense_bytes=dense_bytes)
        held, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert peak < held + (24 << 20)
    assert m.languages == list("abcd")


def test_slices_do_not_change_the_tables(monkeypatch):
    rng = np.random.default_rng(6)
    sample = {lang: [rng.integers(97, 97 + 20, 300, np.uint8).tobytes() for _ in range(40)] for lang in "xy"}
    tables = lambda: [langid.Model(sample, dense_bytes=size) for size in (langid.DENSE_BYTES, 0)]
    dense, sparse = tables()
    monkeypatch.setattr(langid, "PIECE", 700)
    for m, n in zip((dense, sparse), tables(), strict=True):
        pairs = [(m.cost, n.cost), (m.state, n.state)] if m.dense else [(a, b) for x, y in zip(m.tables, n.tables, strict=True) for k, j in zip(x, y, strict=True) for a, b in zip(k, j, strict=True)]
        assert all(np.array_equal(a, b) for a, b in pairs)
