"""Windows of very long texts are those of the text read at once."""

import random

import numpy as np

from tidemark.llm import toxicity as tox


def test_parts_give_the_same_windows(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (0, 1, 31, 32, 33, 47, 48, 49, 500, 5003)]
    net = tox.Network.new()
    want = [net.score(float(net.logits(tox.steps(t)).max()) if t else float(net.p["bo"][0])) for t in texts]
    for size in (60, 700, 1 << 18):
        monkeypatch.setattr(tox, "PART", size)
        assert np.allclose(tox.document_scores(tox.Network(net.p), texts), want, rtol=0, atol=1e-6)
