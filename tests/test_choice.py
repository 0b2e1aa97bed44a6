"""What goes on after the race, lines by folds of neighbours, own regressors: against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_cells import FIRST, close, members, plain, spec, world  # noqa: F401
from tidemark.functions import texts
from tidemark.operators import cells, choice, panel, vintage
from tidemark.operators import estimators as E
from tidemark.plans.choice_queries import steady

SCORES = "method string, size int, mse double, ratio double"
RANKS = "method string, ticket string, rank int"


def test_beating_and_fallback(spark):
    rows = [("a", 5, 1.0, 0.9), ("a", 6, 1.2, 1.1), ("b", 5, None, None), ("b", 6, 1.0, 1.0)]
    some = choice.beating(spark.createDataFrame(rows, SCORES), ["method", "size"], "mse").collect()
    assert [(r["method"], r["size"]) for r in some] == [("a", 5)]
    none = spark.createDataFrame([(m, s, e, 1.5) for m, s, e, _ in rows], SCORES)
    got = {(r["method"], r["size"]) for r in choice.beating(none, ["method", "size"], "mse", fallback=3).collect()}
    assert got == {("a", 5), ("b", 6), ("a", 6)}
    assert choice.beating(spark.createDataFrame([], SCORES), ["method", "size"], "mse").count() == 0
    near = choice.closest(spark.createDataFrame(rows, SCORES), ["method", "size"], most=2).collect()
    assert [(r["method"], r["size"]) for r in near] == [("b", 6), ("a", 5)]


def plain_groups(ranks, scores, least=3):
    last = {}
    for m, size, _, ratio in scores:
        if ratio is not None and ratio < 1:
            last[m] = max(last.get(m, 0), size)
    sets = {m: {t for k, t, r in ranks if k == m and r <= n} for m, n in last.items()}
    order = lambda t: (sum(r for k, n, r in ranks if k in last and n == t), t)
    out, common = {}, 0
    for name, need in (("common", len(last)), ("shared", max(len(last) - 1, 2))):
        have = sorted({t for s in sets.values() for t in s if sum(t in o for o in sets.values()) >= need}, key=order)
        if len(have) >= least and (name == "common" or len(have) > common):
            out[name] = have
        if name == "common":
            common = len(have)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_consensus_groups(spark, seed):
    g = random.Random(seed)
    methods = [f"m{i}" for i in range(g.randint(1, 4))]
    ranks = [(m, f"t{t:02}", i + 1) for m in methods for i, t in enumerate(g.sample(range(14), 11))]
    scores = [(m, s, 1.0, g.choice([0.8, 0.95, 1.0, 1.2, None])) for m in methods for s in range(4, 11)]
    if seed == 5:
        scores = [(m, s, e, 1.5) for m, s, e, _ in scores]
    got = {}
    for r in choice.agreed(spark.createDataFrame(ranks, RANKS), spark.createDataFrame(scores, SCORES)).orderBy("name", "rank").collect():
        got.setdefault(r["name"], []).append(r["ticket"])
    want = plain_groups(ranks, scores)
    assert got == want


def test_shared_group_needs_a_ratio_below_one(spark):
    groups = spark.createDataFrame([(n, t, i + 1, 2, 2) for n in ("common", "shared") for i, t in enumerate("cab" if n == "common" else "cabd")], "name string, ticket string, rank int, needed long, methods long")
    scores = lambda ratio: spark.createDataFrame([("common", 3, 1.0, 1.4), ("shared", 3, 1.0, 0.2), ("shared", 4, 1.0, ratio)], SCORES)
    got = lambda ratio: {(r["method"], r["size"], r["tickets"]) for r in choice.kept(groups, scores(ratio)).collect()}
    assert got(0.9) == {("common", 3, "c a b"), ("shared", 4, "c a b d")}
    assert got(1.0) == {("common", 3, "c a b")}


def test_fixed_groups(spark):
    p = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "ticket string")
    g = spark.createDataFrame([("1", " b  a b x "), ("2", ""), ("3", None), ("4", "y x")], "spec string, tickets string")
    got = {r["spec"]: (r["size"], r["selected"], r["missing"]) for r in choice.fixed(g, p).collect()}
    assert got == {"1": (2, "b a", "x"), "2": (0, "", ""), "3": (0, "", ""), "4": (0, "", "y x")}


def test_p_values_equal_integration(spark):
    rows = [(t, n) for t in (0.0, 0.3, -1.7, 2.5, 6.0) for n in (1, 2, 3, 4, 7, 30, 61)]
    got = spark.createDataFrame([*rows, (1.0, 0)], "t double, df int").select("t", "df", choice.two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    for r in got:
        if not r["df"]:
            assert r["p"] is None
            continue
        n, x = r["df"], np.linspace(0, abs(r["t"]), 20001)
        f = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (1 + x * x / n) ** (-(n + 1) / 2)
        assert r["p"] == pytest.approx(1 - 2 * np.trapezoid(f, x), abs=1e-7), (r["t"], n)


def test_p_values_beside_an_alias(spark):
    """An alias named like the statistic, in the same select, does not reach the p-value."""
    x = spark.createDataFrame([(1.4921661242965794, 24)], "t double, df long")
    p = choice.two_sided(F.col("t"), F.col("df"))
    r = x.select(F.round("t", 1).alias("t"), p.alias("p")).first()
    assert r["t"] == 1.5 and r["p"] == pytest.approx(0.148684950557, abs=1e-10)


def test_names_of_vintages(spark):
    v = spark.createDataFrame([(-2,), (0,), (2,)], "v int")
    name = lambda *grid: [r[0] for r in v.select(texts.vintage_name(F.col("v"), *grid)).collect()]
    assert name(range(-2, 3)) == ["two_back", "zero_back", "two_ahead"]
    assert name() == name(range(-2, 7)) == ["p-2", "p+0", "p+2"]


def sample(seed, n=37, p=5):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, p)) @ g.normal(size=(p, p)) + g.normal(size=p)
    return x, x[:, 0] - 2 * x[:, 2] + g.normal(size=n) * 3, g.uniform(0.5, 1.5, n)


@pytest.mark.parametrize("one_error", [False, True])
def test_ridge_by_folds_of_neighbours(one_error):
    """The penalty is found again by refitting without each of five runs of rows."""
    x, y, w = sample(3)
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd

    def fit(z, y, w, alpha):
        d, share = np.column_stack([np.ones(len(y)), z]), w / w.sum()
        return np.linalg.solve((d * share[:, None]).T @ d + alpha * np.diag([0.0] + [1.0] * z.shape[1]), d.T @ (share * y))

    share = w / w.sum()
    cross = (z - share @ z).T @ (share * (y - share @ y))
    grid = np.abs(cross).max() / 1e-3 * np.geomspace(1, 1e-4, 60)
    edges = [0, 8, 16, 23, 30, 37]
    error, size = np.zeros((5, 60)), np.zeros(5)
    for f, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = np.arange(37)[a:b]
        rest = np.setdiff1d(np.arange(37), out)
        size[f] = w[out].sum()
        for k, alpha in enumerate(grid):
            c = fit(z[rest], y[rest], w[rest], alpha)
            error[f, k] = (w[out] * (y[out] - c[0] - z[out] @ c[1:]) ** 2).sum() / size[f]
    size /= size.sum()
    whole = size @ error
    at = whole.argmin()
    if one_error:
        at = np.flatnonzero(whole <= whole[at] + np.sqrt(size @ (error[:, at] - whole[at]) ** 2 / 4))[0]
    want = fit(z, y, w, grid[at])
    c, beta = E.contiguous(x, y, w, 0.0, one_error=one_error)
    assert np.allclose(beta, want[1:] / sd) and c == pytest.approx(want[0] - mean @ (want[1:] / sd))
    assert (at < whole.argmin()) == one_error


def test_lasso_by_folds_is_a_lasso():
    """At the chosen penalty the optimality conditions hold, the wider one keeps no more columns, tiny samples do not fail."""
    x, y, w = sample(4)
    kept = []
    for name in ("LASSO", "LASSO1"):
        c, beta = E.FOLDED[name](x, y, w)
        z, share = (x - x.mean(0)) / x.std(0), w / w.sum()
        slope = (z - share @ z).T @ (share * (y - c - x @ beta))
        on = beta != 0
        level = np.abs(slope[on]).max() if on.any() else np.abs(slope).max()
        assert np.allclose(np.abs(slope[on]), level, atol=1e-6) and (np.abs(slope) <= level + 1e-6).all()
        kept.append(on.sum())
    assert kept[1] <= kept[0]
    assert E.contiguous(x[:1], y[:1], w[:1])[0] == pytest.approx(y[0])


def test_survival_is_where_columns_leave():
    x, y, w = sample(5)
    alphas = np.geomspace(1e-3, 10, 40)
    path, last = E.survival(x, y, w, alphas)
    z, share = (x - x.mean(0)) / x.std(0), w / w.sum()
    cross = (z - share @ z).T @ (share * (y - share @ y))
    assert (path[alphas > np.abs(cross).max()] == 0).all()
    for j in range(5):
        used = [a for a, b in zip(alphas, path[:, j], strict=True) if abs(b) > 1e-10]
        assert last[j] == (max(used) if used else 0)
    k = 12
    slope = (z - share @ z).T @ (share * (y - share @ y - (z - share @ z) @ path[k]))
    assert np.allclose(slope[path[k] != 0], alphas[k] * np.sign(path[k][path[k] != 0]), atol=1e-6)


def test_own_regressor_equals_plain_loop(spark, world):  # noqa: F811
    names = [r[0] for r in world["x"].select("ticket").distinct().orderBy("ticket").limit(4).collect()]
    table = cells.coefficients(spec(spark, "s", 4, 0, 3, 2, ["mine"]), members(spark, names), world["x"], world["y"], FIRST, lines={"mine": steady})
    own = vintage.target_lags(world["y"].filter("y is not null"), 2, 2)
    got = {(r["date"], r["vintage"]): r["pred"] for r in cells.readings(table, world["x"], world["lags"], own).collect()}
    close(got, plain(world, names, 0, 3, 2, steady, 2))


def test_live_cell_learns_from_all_prints(spark, world):  # noqa: F811
    """The live cell is the one a made-up print of its quarter would have, and other cells stay."""
    names = [r[0] for r in world["x"].select("ticket").distinct().orderBy("ticket").limit(3).collect()]
    s, m, y = spec(spark, "s", 3, 0, 2, 1, ["OLS"]), members(spark, names), world["y"].filter("y is not null and date < date'2001-09-01'")
    live = cells.coefficients(s, m, world["x"], y, "2001-06-01", live="2001-09-01")
    made = cells.coefficients(s, m, world["x"], y.unionByName(spark.sql("select date'2001-09-01' as date, 99d as y")), "2001-06-01")
    beta = lambda t: {(str(r["date"]), r["ticket"], r["lag"]): r["beta"] for r in t.collect()}
    close(beta(live), beta(made))
    assert {d for d, _, _ in beta(live)} == {"2001-06-01", "2001-09-01"}


def test_conversions(spark):
    o = spark.createDataFrame([("y", "2000-03-05", 1.0), ("y", "2000-11-05", 2.0), ("y", "2002-01-01", 3.0), ("q", "2000-01-31", 4.0), ("q", "2000-02-01", None), ("d", "2000-01-02", 5.0), ("d", "2000-01-03", 6.0)], "ticket string, date string, value double").withColumn("date", F.to_date("date"))
    k = spark.createDataFrame([("y", "yearly"), ("q", "quarterly"), ("x", "monthly")], "ticket string, frequency string")
    got = lambda how: {(r["ticket"], str(r["date"]), r["value"]) for r in panel.to_months(o, k, how).collect()}
    rest = {("q", "2000-03-01", 4.0), ("d", "2000-01-01", 6.0)}
    assert got("jan") == rest | {("y", "2000-01-01", 2.0), ("y", "2002-01-01", 3.0)}
    assert got("ffill") == got("mean") == rest | {("y", f"{a}-{m:02}-01", v) for a, v in ((2000, 2.0), (2002, 3.0)) for m in range(1, 13)}
    with pytest.raises(ValueError):
        panel.to_months(o, k, "other")


def test_distance_weights(spark):
    rows = [("a", "2000-03-01", 1.0, 1.0), ("a", "2000-06-01", 2.0, 1.0), ("b", "2000-03-01", 4.0, 1.0), ("b", "2000-06-01", 1.0, 1.0), ("c", "2000-03-01", None, 1.0)]
    m = lambda r: {x["date"]: x for x in choice.weighted_by_distance(spark.createDataFrame(r, "ticket string, date string, pred double, actual double")).collect()}
    got = m(rows)
    assert got["2000-03-01"]["mean"] == 2.5 and got["2000-03-01"]["weighted"] == 1.0 and got["2000-03-01"]["n"] == 2
    same = m([("a", "x", 1.0, 2.0), ("b", "x", 3.0, 2.0)])
    assert same["x"]["weighted"] == 2.0


def test_methods_in_the_race(spark):
    rows = [("a", 5, 1.0, 0.9), ("a", 6, 1.0, 0.9), ("a", 7, 1.0, 1.2), ("b", 5, 1.0, 1.5), ("b", 6, None, None)]
    got = {r["method"]: tuple(r)[1:] for r in choice.by_method(spark.createDataFrame(rows, SCORES)).collect()}
    assert got == {"a": (2, 0.9, 5, 0.9), "b": (0, 1.5, 5, 1.5)}
