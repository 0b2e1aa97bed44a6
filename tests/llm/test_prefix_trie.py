"""The trie of conversations against a plain one, and balanced parentheses against plain matching."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, c string, k1 long, shard int"


def plain(rows):
    """rows: (conv_id, turn, role, text); turns of equal number must be equal."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    out = []
    for v, members in nodes.items():
        below = [w for w in nodes if w[: len(v)] == v]
        kids = {w for w in below if len(w) == len(v) + 1}
        leaves = [w for w in below if not any(len(u) == len(w) + 1 and u[: len(w)] == w for u in below)]
        saved = sum((len(nodes[w]) - 1) * len(w[-1][1].encode()) for w in below if w)
        ends = ",".join(str(c) for c in sorted(c for c in members if built[c] == v))
        out.append((min(members), len(v), min(nodes[v[:-1]]) if v else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in P.trie(frame, **more).collect()), key=str)
    assert got == plain(rows)
    return got


def made(n, seed, texts=3, turns=9):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", None]), r.choice(["é" * i for i in range(texts)])) for c in range(n) for t in range(r.randint(1, turns))]


ODD = [
    (0, None, None, None), (0, 1, "user", "a"), (0, 2, "user", "b" * 100_000), (3, 5, "user", "a"), (3, -1, None, ""), (3, 5, "user", "a"), (-4, 1, "user", "x"), (None, 1, "user", "nobody's"),
    (7, None, "user", "only"), (2**40, 1, "user", "a"), (2**40 + 1, 1, "user", "a"), (9, 1, "a", "bc"), (14, 1, "ab", "c"),
]


def test_odd_rows(spark):
    check(spark, ODD)


def test_no_conversations(spark):
    assert check(spark, []) == [] and check(spark, [(None, 1, "user", "x")]) == []


def test_spine_and_shards_merge(spark):
    """Small trees with a spine of every node that more than two share."""
    check(spark, made(60, 1), heavy=2)
    check(spark, made(60, 2, texts=2))


def test_bands(spark):
    """Deep conversations, cut every three turns, with and without a spine; ranks and names of several blocks."""
    rows = made(20, 3, texts=1, turns=14) + [(100 + c, t, "user", "z" * (t % 3)) for c in range(3) for t in range(20 + c)]
    check(spark, rows, heavy=3, band=3)
    check(spark, rows, heavy=1000, band=4)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    check(spark, made(25, 4, texts=2, turns=13), heavy=5)


def test_copies(spark):
    """A third of all conversations are the same one."""
    rows = [(c, t, "user", f"t{t}") for c in range(0, 400, 5) for t in range(4)] + made(30, 5)
    check(spark, [(c + 7000 if i >= 320 else c, t, r, x) for i, (c, t, r, x) in enumerate(rows)], heavy=10)


@pytest.mark.parametrize("block", [1, 2, 7, 256])
def test_findclose(block):
    r = np.random.default_rng(block)
    for n in (1, 2, 50, 700):
        parent = np.array([-1 if i == 0 or r.random() < 0.1 else r.integers(max(0, i - 5), i) for i in range(n)])
        order, bits = P.preorder(parent)
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.flatnonzero(bits)
        assert sorted(order) == list(range(n)) and P.Parentheses(bits, block).findclose(opens).tolist() == [want[i] for i in opens.tolist()]
