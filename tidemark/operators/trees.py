"""Trees, forests and boosting for many small cells in one job.

rows: (cell, id, y, w, x), x an array with one number a series. A cell is few rows, so it fits one task, and all cells grow in
one job; what comes out is a table of nodes, (cell, tree, node, feature, threshold, low, high, value, cover, gain, rate), from
which readings, importances, staged errors and attributions are taken. feature is -1 in leaves; rows with x at most the
threshold go to `low`; cover is the weight of the rows learned from; a prediction is the sum of rate times leaf over trees.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE = "cell string, tree int, node int, feature int, threshold double, low int, high int, value double, cover double, gain double, rate double"
COLUMNS = ["tree", "node", "feature", "threshold", "low", "high", "value", "cover", "gain", "rate"]


@dataclass(frozen=True)
class Growth:
    """kind: bag (same rows, features in random order), forest (rows drawn anew), boost (each tree on what is left).

    loss: squared or absolute; absolute trees split by and answer with weighted medians.
    """

    kind: str = "forest"
    loss: str = "absolute"
    trees: int = 130
    depth: int = 64
    split: int = 4
    leaf: int = 2
    features: int = 18
    rate: float = 1.0
    seed: int = 42


TREE, TREE4 = Growth("bag", trees=20, split=6, features=0), Growth("bag", trees=20, split=6, leaf=4, features=0)
FOREST, BOOST = Growth(), Growth("boost", "absolute", 100, 3, 6, 3, 0, 0.15)
ATTRIBUTED = Growth("boost", "squared", 300, 2, 2, 1, 0, 0.05)


def median(y: np.ndarray, w: np.ndarray) -> float:
    """Where half the weight lies on each side, between two values if exactly half does."""
    order = np.argsort(y, kind="stable")
    y, up = y[order], np.cumsum(w[order])
    k = int(np.searchsorted(up, up[-1] / 2 - 1e-12 * up[-1]))
    if k + 1 < len(y) and abs(up[k] - up[-1] / 2) <= 1e-12 * up[-1]:
        return float((y[k] + y[k + 1]) / 2)
    return float(y[k])


def answer(y: np.ndarray, w: np.ndarray, loss: str) -> float:
    return median(y, w) if loss == "absolute" else float(w @ y / w.sum())


def impurity(y: np.ndarray, w: np.ndarray, loss: str) -> float:
    off = y - answer(y, w, loss)
    return float(w @ np.abs(off)) if loss == "absolute" else float(w @ off**2)


def _absolute(y: np.ndarray, w: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Weighted absolute error around the median of the first k rows, k from 1 to n - 1, for each feature; place
    (features, rows): each row's place."""
    by = np.argsort(y, kind="stable")
    inside = (place[:, None, by] < np.arange(1, len(y))[None, :, None]) * w[by]
    up = np.cumsum(inside, 2)
    whole = up[:, :, -1:]
    mid = y[by][(up >= whole / 2 - 1e-12 * np.maximum(whole, 1e-300)).argmax(2)]
    return (inside * np.abs(y[by] - mid[:, :, None])).sum(2)


def best_split(x: np.ndarray, y: np.ndarray, w: np.ndarray, features: np.ndarray, loss: str, leaf: int) -> tuple[float, int, float] | None:
    """(error left, feature, threshold) of the split with the least error; the first of equals in the order of features."""
    n, best = len(y), None
    whole = impurity(y, w, loss)
    many = max(1, 4_000_000 // (n * n))
    for some in (features[i : i + many] for i in range(0, len(features), many)):
        order = np.argsort(x[:, some], axis=0, kind="stable")
        v = np.take_along_axis(x[:, some], order, 0)
        ok = v[1:] > v[:-1]
        ok[: leaf - 1] = False
        ok[max(n - leaf, 0) :] = False
        if loss == "squared":
            ws, s = np.cumsum(w[order], 0), np.cumsum((w * y)[order], 0)
            left = float(w @ y**2) - s[:-1] ** 2 / ws[:-1] - (s[-1] - s[:-1]) ** 2 / np.maximum(ws[-1] - ws[:-1], 1e-300)
        else:
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(n)[:, None], 0)
            left = _absolute(y, w, place.T).T + _absolute(y, w, n - 1 - place.T).T[::-1]
        left = np.where(ok, left, np.inf)
        at = left.argmin(0)
        least = left[at, np.arange(len(some))]
        j = int((least <= least.min() + 1e-12 * whole).argmax())
        if np.isfinite(least[j]) and (best is None or least[j] < best[0] - 1e-12 * whole):
            best = (float(least[j]), int(some[j]), float((v[at[j], j] + v[at[j] + 1, j]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, g: Growth, rng: np.random.Generator) -> list[list]:
    """Nodes [feature, threshold, low, high, value, cover, gain] of one tree; rows without weight are not seen."""
    nodes: list[list] = []
    todo = [(np.flatnonzero(w > 0), 0, -1, False)]
    while todo:
        rows, depth, parent, high = todo.pop()
        me, ys, ws = len(nodes), y[rows], w[rows]
        error = impurity(ys, ws, g.loss)
        nodes.append([-1, 0.0, -1, -1, answer(ys, ws, g.loss), float(ws.sum()), 0.0])
        if parent >= 0:
            nodes[parent][3 if high else 2] = me
        if depth >= g.depth or len(rows) < g.split or error <= 1e-12:
            continue
        p = x.shape[1]
        features = rng.permutation(p)
        found = best_split(x[rows], ys, ws, features[: g.features] if g.features else features, g.loss, g.leaf)
        if found is None or found[0] > error - 1e-12:
            continue
        nodes[me][0], nodes[me][1], nodes[me][6] = found[1], found[2], error - found[0]
        low = x[rows, found[1]] <= found[2]
        todo += [(rows[~low], depth + 1, me, True), (rows[low], depth + 1, me, False)]
    return nodes


def predicted(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Leaf values; nodes has the columns of grow()."""
    at = np.zeros(len(x), int)
    while True:
        f = nodes[at, 0].astype(int)
        inner = f >= 0
        if not inner.any():
            return nodes[at, 4]
        low = x[np.arange(len(x)), np.maximum(f, 0)] <= nodes[at, 1]
        at = np.where(inner, np.where(low, nodes[at, 2], nodes[at, 3]), at).astype(int)


def ensemble(x: np.ndarray, y: np.ndarray, w: np.ndarray, g: Growth) -> tuple[list[np.ndarray], list[float], np.ndarray]:
    """(trees, rate of each, which rows each tree saw). A boosted ensemble starts with a tree of one leaf."""
    n, trees, rates, saw = len(y), [], [], []
    left = y.astype(float).copy()
    if g.kind == "boost":
        trees.append(np.array([[-1, 0, -1, -1, answer(y, w, g.loss), w.sum(), 0]]))
        rates.append(1.0)
        saw.append(np.ones(n, bool))
        left -= trees[0][0, 4]
    for i in range(g.trees):
        rng = np.random.default_rng(g.seed + i)
        weight = w * np.bincount(rng.integers(0, n, n), minlength=n) if g.kind == "forest" else w
        if not (weight > 0).any():
            weight = w
        if g.kind == "boost" and g.loss == "absolute":  # grown on signs, answers by medians of what is left
            t = np.array(grow(x, np.sign(left), weight, Growth(**{**g.__dict__, "loss": "squared"}), rng))
            leaf = _leaves(t, x)
            for k in np.unique(leaf):
                t[k, 4] = median(left[leaf == k], weight[leaf == k])
        else:
            t = np.array(grow(x, left, weight, g, rng))
        if g.kind == "boost":
            left = left - g.rate * predicted(t, x)
        trees.append(t)
        rates.append(g.rate if g.kind == "boost" else 1.0 / g.trees)
        saw.append(weight > 0)
    return trees, rates, np.array(saw)


def _leaves(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    named = nodes.copy()
    named[:, 4] = np.arange(len(nodes))
    return predicted(named, x).astype(int)


def _cell(t: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    t = t.sort_values("id", ignore_index=True)
    return t, np.stack(t["x"].to_list()).astype(float), t["y"].to_numpy(float), t["w"].to_numpy(float)


def grown(rows: DataFrame, g: Growth) -> DataFrame:
    """The table of nodes of every cell. Rows without y are not learned from; a cell without rows grows nothing."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t, x, y, w = _cell(t)
        trees, rates, _ = ensemble(x, y, w, g)
        parts = [pd.DataFrame(np.column_stack([np.full(len(n), i), np.arange(len(n)), n, np.full(len(n), r)]), columns=COLUMNS) for i, (n, r) in enumerate(zip(trees, rates, strict=True))]
        out = pd.concat(parts, ignore_index=True).astype(dict.fromkeys(["tree", "node", "feature", "low", "high"], "int32"))
        out.insert(0, "cell", t["cell"].iloc[0])
        return out

    return rows.filter("y is not null and w > 0").groupBy("cell").applyInPandas(one, TABLE)


def _trees(t: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    t = t.sort_values(["tree", "node"])
    parts = [p for _, p in t.groupby("tree", sort=True)]
    return [p[["feature", "threshold", "low", "high", "value", "cover", "gain"]].to_numpy(float) for p in parts], np.array([p["rate"].iloc[0] for p in parts])


def readings(table: DataFrame, rows: DataFrame) -> DataFrame:
    """(cell, id, pred) of rows (cell, id, x): every row by its cell's trees; rows of cells without trees drop out."""

    def one(trees: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if trees.empty or r.empty:
            return pd.DataFrame({"cell": pd.Series([], dtype=str), "id": pd.Series([], dtype="int64"), "pred": pd.Series([], dtype=float)})
        nodes, rates = _trees(trees)
        x = np.stack(r["x"].to_list()).astype(float)
        return pd.DataFrame({"cell": r["cell"], "id": r["id"], "pred": rates @ np.array([predicted(n, x) for n in nodes])})

    return table.groupBy("cell").cogroup(rows.select("cell", "id", "x").groupBy("cell")).applyInPandas(one, "cell string, id long, pred double")


def importances(table: DataFrame) -> DataFrame:
    """(cell, feature, importance): what each feature's splits took off the error, of each tree in shares, averaged over
    trees that split; a cell's importances add up to 1."""
    split = table.filter("feature >= 0")
    each = split.groupBy("cell", "tree", "feature").agg(F.sum("gain").alias("g"))
    total = split.groupBy("cell", "tree").agg(F.sum("gain").alias("all")).filter("all > 0")
    share = each.join(total, ["cell", "tree"]).groupBy("cell", "feature").agg(F.sum(F.col("g") / F.col("all")).alias("s"))
    n = total.groupBy("cell").agg(F.count("*").alias("n"))
    return share.join(n, "cell").select("cell", "feature", (F.col("s") / F.col("n")).alias("importance"))


def staged(table: DataFrame, rows: DataFrame) -> DataFrame:
    """(cell, trees, mse): weighted error of a boosted ensemble's first trees, from the one leaf it starts with."""

    def one(trees: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if trees.empty or r.empty:
            return pd.DataFrame({"cell": pd.Series([], dtype=str), "trees": pd.Series([], dtype="int32"), "mse": pd.Series([], dtype=float)})
        nodes, rates = _trees(trees)
        _, x, y, w = _cell(r)
        path = np.cumsum([a * predicted(n, x) for n, a in zip(nodes, rates, strict=True)], axis=0)
        return pd.DataFrame({"cell": r["cell"].iloc[0], "trees": np.arange(len(nodes), dtype=np.int32), "mse": ((y - path) ** 2 @ w) / w.sum()})

    return table.groupBy("cell").cogroup(rows.filter("y is not null and w > 0").groupBy("cell")).applyInPandas(one, "cell string, trees int, mse double")


def out_of_bag(rows: DataFrame, g: Growth) -> DataFrame:
    """(cell, rows, r2) of forests: each row read by the trees that did not see it; rows that all saw drop out."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t, x, y, w = _cell(t)
        trees, _, saw = ensemble(x, y, w, g)
        each = np.array([predicted(n, x) for n in trees])
        out = (~saw).sum(0)
        on = out > 0
        mean = np.where(~saw, each, 0).sum(0)[on] / out[on]
        spread = ((y[on] - y[on].mean()) ** 2).sum() if on.any() else 0.0
        return pd.DataFrame({"cell": [t["cell"].iloc[0]], "rows": [int(on.sum())], "r2": [1 - ((y[on] - mean) ** 2).sum() / spread if spread > 0 else None]})

    return rows.filter("y is not null and w > 0").groupBy("cell").applyInPandas(one, "cell string, rows int, r2 double")


def attributions(nodes: np.ndarray, x: np.ndarray) -> dict[int, np.ndarray]:
    """Shapley values of one tree by feature, for each row. A feature that is not in a coalition is averaged over its
    splits by cover. A tree of depth two has at most three features, so all coalitions are taken."""
    used = sorted({int(f) for f in nodes[:, 0] if f >= 0})

    def value(known: frozenset[int], node: int = 0) -> np.ndarray:
        f = int(nodes[node, 0])
        if f < 0:
            return np.full(len(x), nodes[node, 4])
        low, high = int(nodes[node, 2]), int(nodes[node, 3])
        a, b = value(known, low), value(known, high)
        if f in known:
            return np.where(x[:, f] <= nodes[node, 1], a, b)
        return (nodes[low, 5] * a + nodes[high, 5] * b) / (nodes[low, 5] + nodes[high, 5])

    seen: dict[frozenset[int], np.ndarray] = {}
    of = lambda s: seen[s] if s in seen else seen.setdefault(s, value(s))
    out, m = {}, len(used)
    for f in used:
        others = [o for o in used if o != f]
        out[f] = sum(factorial(k) * factorial(m - k - 1) / factorial(m) * (of(frozenset((*s, f))) - of(frozenset(s))) for k in range(m) for s in combinations(others, k))
    return out


def attributed(table: DataFrame, rows: DataFrame) -> DataFrame:
    """(cell, feature, score): mean absolute attribution of each feature over the rows (cell, id, x); features that no tree
    uses, or that add nothing, drop out."""

    def one(trees: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if trees.empty or r.empty:
            return pd.DataFrame({"cell": pd.Series([], dtype=str), "feature": pd.Series([], dtype="int32"), "score": pd.Series([], dtype=float)})
        nodes, rates = _trees(trees)
        x = np.stack(r["x"].to_list()).astype(float)
        total: dict[int, np.ndarray] = {}
        for n, a in zip(nodes, rates, strict=True):
            for f, v in attributions(n, x).items():
                total[f] = total.get(f, 0) + a * v
        score = {f: float(np.abs(v).mean()) for f, v in total.items()}
        kept = sorted(f for f, s in score.items() if s > 0)
        return pd.DataFrame({"cell": r["cell"].iloc[0], "feature": np.array(kept, np.int32), "score": [score[f] for f in kept]})

    return table.groupBy("cell").cogroup(rows.select("cell", "id", "x").groupBy("cell")).applyInPandas(one, "cell string, feature int, score double")
