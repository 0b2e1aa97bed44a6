import random

import numpy as np

from tidemark.llm import toxicity

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def test_pieces_hold_every_part_of_a_word():
    rng = random.Random(1)
    for n in (1, 64, 65, 66, 88, 89, 116, 117, 500):
        w = "".join(rng.choices(LETTERS, k=n))
        got = toxicity.steps(f"Two {w.upper()} words")
        assert got[0] == "two" and got[-1] == "words"
        parts = got[1:-1]
        assert parts == [w] if n <= 64 else all(len(x) <= 32 for x in parts)
        assert parts[0] + "".join(x[4:] for x in parts[1:]) == w
        assert all(any(w[i : i + 5] in x for x in parts) for i in range(max(1, n - 4)))
    assert toxicity.steps("") == [] and toxicity.steps(" \n") == []


def test_toxic_part_far_inside_one_word():
    """Texts of one word each; what makes one toxic lies beyond its first 64 characters."""
    rng = random.Random(3)

    def text(toxic, at):
        w = "".join(rng.choices(LETTERS, k=400))
        return w[:at] + "grobschmutz" * 2 + w[at:] if toxic else w

    label = np.arange(120) % 2
    net = toxicity.train([text(y, rng.randrange(70, 300)) for y in label], label, 0.5)
    test = np.arange(40) % 2
    score = np.asarray(toxicity.document_scores(net, [text(y, rng.randrange(70, 300)) for y in test]))
    assert ((score >= toxicity.THRESHOLD) == test).sum() >= 36
