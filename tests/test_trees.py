"""Trees against exhaustive search, attributions against all coalitions, forests against themselves."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from tidemark.operators import trees as T


def sample(seed, n=30, p=4):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, p)), 1)
    return x, np.round(np.where(x[:, 0] > 0, 3.0, -1.0) + x[:, 1] + r.normal(size=n) * 0.2, 2), r.uniform(0.5, 2, n)


def plain_error(y, w, loss):
    if loss == "squared":
        return (w * (y - (w @ y) / w.sum()) ** 2).sum()
    return min((w * np.abs(y - m)).sum() for m in y)


@pytest.mark.parametrize("loss", ["squared", "absolute"])
@pytest.mark.parametrize("leaf", [1, 2, 4])
def test_split_is_the_best_of_all(loss, leaf):
    for seed in range(4):
        x, y, w = sample(seed)
        got = T.best_split(x, y, w, np.arange(4), loss, leaf)
        best = np.inf
        for f in range(4):
            for c in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= c
                if min(low.sum(), (~low).sum()) >= leaf:
                    best = min(best, plain_error(y[low], w[low], loss) + plain_error(y[~low], w[~low], loss))
        low = x[:, got[1]] <= got[2]
        assert got[0] == pytest.approx(best) == pytest.approx(plain_error(y[low], w[low], loss) + plain_error(y[~low], w[~low], loss))


def test_tree_equals_exhaustive_tree():
    """Depth three, grown by hand with the same rule; predictions agree on every row."""
    x, y, w = sample(9, 40, 3)
    g = T.Growth("bag", "squared", 1, 3, 4, 2, 0)
    nodes = np.array(T.grow(x, y, w, g, np.random.default_rng(0)))

    def by_hand(rows, depth):
        mean = (w[rows] @ y[rows]) / w[rows].sum()
        error = plain_error(y[rows], w[rows], "squared")
        best = None
        if depth < 3 and len(rows) >= 4:
            for f in range(3):
                v = np.unique(x[rows, f])
                for c in (v[1:] + v[:-1]) / 2:
                    a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    if min(len(a), len(b)) >= 2:
                        e = plain_error(y[a], w[a], "squared") + plain_error(y[b], w[b], "squared")
                        if best is None or e < best[0] - 1e-12:
                            best = (e, a, b)
        if best is None or best[0] > error - 1e-12:
            return dict.fromkeys(rows.tolist(), mean)
        return by_hand(best[1], depth + 1) | by_hand(best[2], depth + 1)

    want = by_hand(np.arange(40), 0)
    assert np.allclose(T.predicted(nodes, x), [want[i] for i in range(40)])


def test_median_halves_the_weight():
    assert T.median(np.array([3.0, 1.0, 2.0]), np.ones(3)) == 2.0
    assert T.median(np.array([4.0, 1.0, 2.0, 3.0]), np.ones(4)) == 2.5
    assert T.median(np.array([1.0, 9.0]), np.array([3.0, 1.0])) == 1.0


def test_attributions_add_up_and_equal_all_coalitions():
    x, y, w = sample(5)
    for depth in (2, 3):
        nodes = np.array(T.grow(x, y, w, T.Growth("boost", "squared", 1, depth, 2, 1, 0), np.random.default_rng(1)))
        got = T.attributions(nodes, x)

        def value(known, row, node=0):
            f = int(nodes[node, 0])
            if f < 0:
                return nodes[node, 4]
            low, high = int(nodes[node, 2]), int(nodes[node, 3])
            if f in known:
                return value(known, row, low if x[row, f] <= nodes[node, 1] else high)
            return (nodes[low, 5] * value(known, row, low) + nodes[high, 5] * value(known, row, high)) / nodes[node, 5]

        for row in range(len(x)):
            for f in range(4):  # over all features, used or not
                others = [o for o in range(4) if o != f]
                want = sum(factorial(k) * factorial(3 - k) / factorial(4) * (value({*s, f}, row) - value(set(s), row)) for k in range(4) for s in combinations(others, k))
                assert (got[f][row] if f in got else 0.0) == pytest.approx(want, abs=1e-9)
        total = sum(got.values()) + value(set(), 0)
        assert np.allclose(total, T.predicted(nodes, x))


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for c in ("a", "b", "c"):
        x, y, w = sample(ord(c), 40)
        out += [(c, i, float(y[i]), float(w[i]), x[i].tolist(), "extra") for i in range(40)]
    out += [("a", 99, None, 1.0, [0.0] * 4, "extra"), ("flat", 0, 1.0, 1.0, [1.0] * 4, "extra"), ("flat", 1, 1.0, 1.0, [1.0] * 4, "extra")]
    return spark.createDataFrame(out, "cell string, id long, y double, w double, x array<double>, tree string")


SMALL = [T.Growth(trees=15, features=2), T.Growth("boost", "absolute", 20, 3, 4, 2, 0, 0.3), T.Growth("boost", "squared", 20, 2, 2, 1, 0, 0.3), T.Growth("bag", trees=3, split=6, features=0)]


@pytest.mark.parametrize("g", SMALL)
def test_tables_read_like_plain_ensembles(spark, rows, g):
    got = {(r["cell"], r["id"]): r["pred"] for r in T.readings(T.grown(rows, g), rows).collect()}
    again = {(r["cell"], r["id"]): r["pred"] for r in T.readings(T.grown(rows.repartition(7), g), rows).collect()}
    assert got == again and len(got) == 123 and got["flat", 0] == pytest.approx(1.0)
    for c in ("a", "b"):
        x, y, w = sample(ord(c), 40)
        trees, rates, _ = T.ensemble(x, y, w, g)
        want = sum(a * T.predicted(n, x) for n, a in zip(trees, rates, strict=True))
        assert np.allclose([got[c, i] for i in range(40)], want)
        assert np.abs(want - y).mean() < np.abs(y - np.median(y)).mean() / 2


def test_importances_and_stages(spark, rows):
    table = T.grown(rows, SMALL[2])
    shares = {}
    for r in T.importances(table).collect():
        shares.setdefault(r["cell"], {})[r["feature"]] = r["importance"]
    assert set(shares) == {"a", "b", "c"} and all(sum(s.values()) == pytest.approx(1.0) and s[0] > s.get(3, 0) for s in shares.values())
    path = {(r["cell"], r["trees"]): r["mse"] for r in T.staged(table, rows).collect()}
    x, y, w = sample(ord("a"), 40)
    mean = (w @ y) / w.sum()
    assert path["a", 0] == pytest.approx((w @ (y - mean) ** 2) / w.sum()) and all(path["a", k + 1] <= path["a", k] + 1e-9 for k in range(20))


def test_out_of_bag_equals_plain(spark, rows):
    got = {r["cell"]: r for r in T.out_of_bag(rows, SMALL[0]).collect()}
    x, y, w = sample(ord("a"), 40)
    trees, _, saw = T.ensemble(x, y, w, SMALL[0])
    preds = {}
    for t, s in zip(trees, saw, strict=True):
        for i in np.flatnonzero(~s):
            preds.setdefault(i, []).append(T.predicted(t, x[i : i + 1])[0])
    on = sorted(preds)
    off = sum((y[i] - np.mean(preds[i])) ** 2 for i in on)
    assert got["a"]["rows"] == len(on) and got["a"]["r2"] == pytest.approx(1 - off / ((y[on] - y[on].mean()) ** 2).sum()) and got["a"]["r2"] > 0.3
    assert got["flat"]["r2"] is None


def test_attribution_order(spark, rows):
    score = {}
    for r in T.attributed(T.grown(rows, SMALL[2]), rows).collect():
        score.setdefault(r["cell"], {})[r["feature"]] = r["score"]
    assert all(max(s, key=s.get) == 0 for s in score.values()) and "flat" not in score
