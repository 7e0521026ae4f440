"""Equal contexts are looked up once, however often texts hold them, and nothing else changes."""

import numpy as np

from tests.llm.test_brute_force import model  # noqa: F401
from weftgraph.llm import mixlm


def test_repeats_are_not_looked_up_again(model, monkeypatch):  # noqa: F811
    looked_up, bits = mixlm.MixModel.looked_up, []
    monkeypatch.setattr(mixlm.MixModel, "looked_up", lambda self, buffer, b, taught: bits.append(len(b.bit)) or looked_up(self, buffer, b, taught))
    one = mixlm.pieces(b"the cat sat on the dog, a zebra and a log")
    for work in (model.log10, model.slopes):
        bits.clear()
        first, often = work(one), work(one * 300)
        assert sum(bits) == 2 * bits[0]
        if work == model.slopes:
            assert np.allclose(often, 300 * first, rtol=1e-4, atol=1e-2)
        else:
            assert all(np.allclose(x, first[0], rtol=1e-6) for x in often)


def test_scores_are_the_sums_of_all_bytes(model, monkeypatch):  # noqa: F811
    """Lanes, batches of lanes and rare bytes in the middle of a batch, taught and not."""
    monkeypatch.setattr(mixlm, "BYTES", 5000)
    monkeypatch.setattr(mixlm, "PART", 700)
    texts = [b"", b"a dog", b"the cat sat " * 600, "é中 zebra".encode() * 30, b"the cat", b"x" * mixlm.LANE, b"a dog"]
    some = [p for t in texts for p in mixlm.pieces(t)]
    taught = np.arange(len(some)) % 2 == 0
    each = model.log10(some, taught)
    assert [len(x) for x in each] == [len(body) for _, body in some]
    assert np.allclose([x.sum() for x in each], model.scores(mixlm.Batch(some, model.code.symbol, taught)), rtol=1e-5, atol=1e-5)
    for x, piece, t in zip(each, some, taught):
        assert np.allclose(x, model.log10([piece], np.array([t]))[0], rtol=1e-4, atol=1e-5)


def test_once_finds_equal_hashes():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 1), (9, 2), (50_000, 300), (50_000, 10**9)):
        key = rng.integers(0, 1 << 64, kinds if kinds < n else n, np.uint64)[rng.integers(0, min(n, kinds), n)]
        first, of = mixlm.once(key)
        assert (key[first][of] == key).all() and (of[first] == np.arange(len(first))).all()
        assert len(first) <= 1.02 * len(np.unique(key))
