"""What the language model learns: from all teaching texts, none left out."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_brute_force import model  # noqa: F401
from weftgraph.llm import mixlm


def test_slopes_are_those_of_the_cost(model):  # noqa: F811
    """Gradient and second derivatives against differences of the cost of every bit."""
    some = [p for t in (b"the cat sat on the dog", b"zebra! a log", b"") for p in mixlm.pieces(t)]
    buffer = mixlm.Buffer(some)
    bits = mixlm.Bits(buffer, model.code)
    places, gate = model.looked_up(buffer, bits, np.ones(len(some), bool))
    x, y, live = mixlm.STRETCH[mixlm.LESS[np.array(places)]].astype(float), bits.bit, bits.node != mixlm.IDLE

    def cost(weights):
        z = (weights[:, gate] * x).sum(axis=0)
        return (np.log1p(np.exp(-np.where(y == 1, z, -z))) * live).sum()

    w, found = model.weights.astype(float), model.slopes(some)
    for g in np.unique(gate):
        for i in range(len(w)):
            step = np.zeros_like(w)
            step[i, g] = 1e-3
            up, down = cost(w + step), cost(w - step)
            assert np.isclose(found[g, i, 0], (up - down) / 2e-3, rtol=1e-2, atol=1e-2)
            assert np.isclose(found[g, i, 1 + i], (up + down - 2 * cost(w)) / 1e-6, rtol=2e-2, atol=2e-2)


def test_every_teaching_text_moves_the_weights(spark, monkeypatch):
    """700 texts teach, more than any former sample; the slopes are summed over each of them."""
    texts = [f"text {i} of the corpus has {i * 7919 % 1000} words and {'ab' * (i % 5)} more" for i in range(700)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    moved = []
    monkeypatch.setattr(mixlm.MixModel, "move", lambda self, slopes: moved.append((self, slopes)))
    mixlm.lm_scores(docs, F.col("doc_id") % 7 != 2)
    (found, slopes), taught = moved[0], [mixlm.normal(t) for i, t in enumerate(texts) if i % 7 != 2]
    assert len(moved) == 1 and np.allclose(slopes, found.slopes([p for t in taught for p in mixlm.pieces(t)]), rtol=1e-4, atol=1e-2)
    seen = np.bincount(np.frombuffer(b"\n".join([*taught, b""]), np.uint8), minlength=256).astype(float)
    seen[97:123] += 1
    assert (found.code.symbol == mixlm.Code(seen).symbol).all()
