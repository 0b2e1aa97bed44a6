"""Screens that SQL cannot express, against plain versions on the small tables."""

import numpy as np
import pandas as pd
import pytest

from tests.conftest import SF
from tidemark.operators import screens
from tidemark.plans import selection_queries as sq
from tidemark.plans.queries import _growths


@pytest.fixture(scope="module")
def tables(spark):
    g, y = (x.toPandas() for x in _growths(spark, SF))
    wide = g.pivot(index="date", columns="ticket", values="growth").sort_index()
    return wide.astype(float), y.set_index("date")["growth"].sort_index().astype(float)


def before(x):
    return x[pd.to_datetime(x.index) < sq.TEST]


def sandwich_t(y, x, lags=4):
    """|t| of the last column: whole design, Newey-West."""
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    g = x * (y - x @ beta)[:, None]
    s = g.T @ g
    for k in range(1, lags + 1):
        m = g[k:].T @ g[:-k]
        s = s + (1 - k / (lags + 1)) * (m + m.T)
    return abs(beta[-1]) / np.sqrt((inverse @ s @ inverse)[-1, -1])


def test_multiple_testing(spark, tables):
    """With a high level several stages run."""
    from statistics import NormalDist

    wide, y = before(tables[0]), before(tables[1])
    for level in (0.05, 20.0):
        frame = pd.DataFrame({"y": y, "y1": y.shift(1), "y2": y.shift(2)})
        chosen, stage_of, last = [], {}, {}
        for stage in range(1, 6):
            critical = NormalDist().inv_cdf(1 - level / (2 * wide.shape[1] ** (1.0 if stage == 1 else 1.5)))
            new = []
            for v in wide.columns.difference(chosen):
                block = pd.concat([frame, wide[chosen], wide[[v]]], axis=1).dropna()
                if len(block) > 6 + len(chosen):
                    last[v] = sandwich_t(block["y"].to_numpy(), np.column_stack([np.ones(len(block)), block.drop(columns="y").to_numpy()]))
                    if last[v] > critical:
                        new.append(v)
            if not new:
                break
            chosen += new
            stage_of.update({v: stage for v in new})
            if len(chosen) > y.notna().sum() - 10:
                break
        out = screens.multiple_testing(*_growths(spark, SF), sq.TEST, level).collect()
        assert {r["ticket"]: r["stage"] for r in out} == {v: stage_of.get(v) for v in wide.columns}
        assert all(np.isclose(r["score"], last.get(r["ticket"], 0.0), rtol=1e-6) for r in out)
    assert screens.multiple_testing(*(x.limit(0) for x in _growths(spark, SF)), sq.TEST).count() == 0


def test_inclusion_by_subsets():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 5))
    x[:, 4] = x[:, 3]
    y = x[:, 0] * 2 + rng.standard_normal(20)
    weights, share = [], np.zeros(5)
    for m in range(32):
        on = [j for j in range(5) if m >> j & 1]
        z = np.column_stack([np.ones(20), x[:, on]])
        rss = ((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2).sum()
        weights.append((np.exp(-(20 * np.log(rss / 20) + z.shape[1] * np.log(20)) / 2), on))
    for w, on in weights:
        share[on] += w / sum(v for v, _ in weights)
    assert np.allclose(screens.inclusion(x, y), share, atol=1e-9)


def test_model_averaging_reaches_every_series(spark, tables):
    out = sq.m04(spark, SF).collect()
    assert {r["ticket"] for r in out} == set(tables[0].columns) and all(0 <= r["score"] <= 1 for r in out)
    few = screens.model_averaging(*_growths(spark, SF), sq.TEST, turns=2)
    assert few.count() <= 30


def test_factors_and_their_number(spark, tables):
    wide = before(tables[0])
    wide = wide[pd.to_datetime(wide.index) >= sq.FIRST].dropna(axis=1)
    z = (wide - wide.mean()) / wide.std(ddof=0)
    t, n = z.shape
    u, s, v = np.linalg.svd(z.to_numpy(), full_matrices=False)
    got = {r["r"]: r for r in sq.m09(spark, SF).collect()}
    for r in range(11):
        left = (wide.to_numpy() ** 2).mean() if r == 0 else ((z.to_numpy() - u[:, :r] * s[:r] @ v[:r]) ** 2).mean()
        assert np.isclose(got[r]["ic1"], np.log(left) + r * (n + t) / (n * t) * np.log(n * t / (n + t)), atol=1e-5)
        assert np.isclose(got[r]["ic3"], np.log(left) + r * np.log(min(n, t)) / min(n, t), atol=1e-5)
    read = sq.m11(spark, SF).toPandas().pivot(index="date", columns="pc", values="value").sort_index()
    inside = read.loc[wide.index].to_numpy()
    assert np.allclose(np.abs(inside), np.abs(u[:, :5] * s[:5]), atol=1e-4)
    later = read.drop(wide.index)
    assert len(later) >= 1


def test_frozen_errors(spark, tables):
    ranks = sq.rankings(spark, SF).toPandas()
    out = {(r["method"], r["size"]): r["rmse"] for r in sq.m07(spark, SF).collect()}
    y = tables[1].dropna()
    wide = tables[0].reindex(y.index)
    for (method, size), rmse in out.items():
        names = sorted(ranks[(ranks["method"] == method) & (ranks["rank"] <= size)]["ticket"])
        x = wide[names].dropna(axis=1)
        a = np.asarray(pd.to_datetime(x.index) < sq.TEST)
        z = ((x - x[a].mean()) / x[a].std(ddof=0)).to_numpy()
        values, vectors = np.linalg.eigh(np.cov(z[a].T))
        f = np.column_stack([np.ones(len(z)), z @ vectors[:, ::-1][:, :3]])
        line = np.linalg.lstsq(f[a], y[a], rcond=None)[0]
        assert np.isclose(rmse, np.sqrt(((f[~a] @ line - y[~a]) ** 2).mean()), atol=1e-4)


def test_pruning_follows_the_walk(spark):
    rng = np.random.default_rng(5)
    names = [f"v{i:02d}" for i in range(40)]
    pairs = [(a, b, float(rng.uniform(-1, 1))) for i, a in enumerate(names) for b in names[i + 1 :]]
    score = {v: float(rng.integers(0, 10)) for v in names}
    r = {frozenset(p[:2]): abs(p[2]) for p in pairs}
    kept = []
    for v in sorted(names, key=lambda v: (-score[v], v)):
        if all(r[frozenset((v, k))] < 0.8 for k in kept):
            kept.append(v)
    out = screens.pruned(spark.createDataFrame(list(score.items()), "ticket string, score double"), spark.createDataFrame(pairs, "a string, b string, r double"), 0.8)
    assert sorted(x["ticket"] for x in out.collect()) == sorted(kept)


def test_ridge_leaves_each_quarter_out(spark, tables):
    ranks = sq.rankings(spark, SF).toPandas()
    y = tables[1].dropna()
    wide = tables[0].reindex(y.index)
    out = sq.m23(spark, SF).toPandas()
    assert len(out) == 2 * 3 * len(sq.ALPHAS)
    for r in out[out["size"] == 5].itertuples():
        x = wide[sorted(ranks[(ranks["method"] == r.method) & (ranks["rank"] <= r.size)]["ticket"])].dropna(axis=1)
        a = np.asarray(pd.to_datetime(x.index) < sq.TEST)
        z, t = ((x - x[a].mean()) / x[a].std(ddof=0)).to_numpy()[a], y[a].to_numpy()
        errors = []
        for i in range(len(t)):
            k = np.arange(len(t)) != i
            design = np.column_stack([np.ones(k.sum()), z[k]])
            beta = np.linalg.solve(design.T @ design + np.diag([0.0] + [r.alpha] * z.shape[1]), design.T @ t[k])
            errors.append((t[i] - beta @ np.r_[1.0, z[i]]) ** 2)
        assert np.isclose(r.loo, np.mean(errors), rtol=1e-5)
    best = {(r["method"], r["size"]): r["loo"] for r in sq.m15(spark, SF).collect()}
    assert best == out.groupby(["method", "size"])["loo"].min().to_dict()
