"""Fitted cells against a plain loop over quarters and vintages, estimators against what defines them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tests.conftest import SF
from tidemark.operators import cells, panel, vintage
from tidemark.operators import estimators as E
from tidemark.plans.pool_queries import brand_lags, brands
from tidemark.testbed import target

FIRST = "2001-03-01"


def shift(d, k):
    m = d.year * 12 + d.month - 1 + k
    return dt.date(m // 12, m % 12 + 1, 1)


@pytest.fixture(scope="module")
def world(spark):
    y = target(spark, SF).select("date", panel.growth(F.col("y"), F.lag("y").over(W.orderBy("date"))).alias("y"))
    y = spark.createDataFrame(y.collect(), y.schema)
    g = brands(spark, SF)
    g = spark.createDataFrame(g.collect(), g.schema)
    x = cells.carried(g, str(y.agg(F.max("date")).first()[0]))
    x = spark.createDataFrame(x.collect(), x.schema)
    lags = brand_lags(x)
    return {"y": y, "g": g, "x": x, "lags": spark.createDataFrame(lags.collect(), lags.schema)}


def members(spark, names):
    return spark.createDataFrame([("m", n, i + 1) for i, n in enumerate(names)], "method string, ticket string, rank int")


def spec(spark, name, size, factors, flat, lags, estimators):
    return spark.createDataFrame([(name, "m", size, factors, flat, lags, estimators)], "spec string, method string, size int, factors int, flat int, lags int, estimators array<string>")


def plain(world, names, factors, flat, lags, fitted, print_lag):
    """Readings by walking over quarters and vintages on blanked copies of the raw panel."""
    y = {r["date"]: r["y"] for r in world["y"].collect() if r["y"] is not None}
    raw = {}
    for r in world["g"].filter("value is not null").collect():
        raw.setdefault(r["ticket"], {})[r["date"]] = r["value"]
    pub = {r[0]: r[1] for r in world["lags"].collect()}
    start = min(d for v in raw.values() for d in v)
    out = {}
    for t in sorted(y):
        if str(t) < FIRST:
            continue
        months = [shift(start, k) for k in range((t.year - start.year) * 12 + t.month - start.month + 1)]

        def fill(last):
            """Each series as known up to month number last[name], carried on; gaps before the first value take it."""
            rows = []
            for n in names:
                v, now = [], None
                first = raw[n][min(raw[n])]
                for i, m in enumerate(months):
                    now = raw[n].get(m, now) if i <= last[n] else now
                    v.append(first if now is None else now)
                rows.append(v)
            return np.array(rows)

        end = len(months) - 4
        full = fill(dict.fromkeys(names, end))[:, : end + 1]
        if factors:
            mean, sd = full.mean(1, keepdims=True), full.std(1, keepdims=True)
            axes = np.linalg.svd(((full - mean) / sd).T, full_matrices=False)[2][:factors]
            space = lambda a: axes @ ((a - mean) / sd)  # noqa: E731, B023
        else:
            space = lambda a: a
        rows = [(i, m) for i, m in enumerate(months) if m in y and m < t and flat - 1 <= i <= end]
        z = space(full)
        own = [[y.get(shift(m, -3 * (k + 1)), np.nan) for k in range(1, lags + 1)] for _, m in rows]
        own = np.array(own, float).reshape(len(rows), lags)
        means = np.nanmean(own, 0) if lags else np.zeros(0)
        own = np.where(np.isnan(own), means, own)
        design = np.column_stack([np.concatenate([z[:, i - k] for k in range(flat)]) for i, _ in rows]).T
        design = np.column_stack([design, own])
        w = 0.95 ** np.array([(rows[-1][1] - m).days / 90 for _, m in rows])
        c, b = fitted(design, np.array([y[m] for _, m in rows]), w)
        for v in range(-2, 7):
            known = fill({n: len(months) - 1 - max(0, pub[n] - v) for n in names})
            z = space(known)
            printed = [y[q] for q in sorted(y, reverse=True) if q < t and shift(q, print_lag) <= shift(t, v)]
            tail = [printed[k] if k < len(printed) else means[k] for k in range(lags)]
            out[t, v] = c + np.concatenate([*[z[:, -1 - k] for k in range(flat)], tail]) @ b
    return out


def close(got, want, places=7):
    assert got.keys() == want.keys() and want
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=10**-places, abs=10**-places), k


@pytest.mark.parametrize(("factors", "flat", "lags", "name"), [(0, 1, 0, "OLS"), (0, 3, 0, "OLSR"), (3, 3, 2, "OLS"), (2, 4, 1, "OLSR"), (0, 2, 2, "LASSO")])
def test_readings_equal_plain_loop(spark, world, factors, flat, lags, name):
    names = [r[0] for r in world["x"].select("ticket").distinct().orderBy("ticket").limit(5).collect()]
    table = cells.coefficients(spec(spark, "s", 5, factors, flat, lags, [name]), members(spark, names), world["x"], world["y"], FIRST)
    own = vintage.target_lags(world["y"].filter("y is not null"), 2, max(lags, 1))
    got = {(r["date"], r["vintage"]): r["pred"] for r in cells.readings(table, world["x"], world["lags"], own).collect()}
    close(got, plain(world, names, factors, flat, lags, E.LINES[name], 2), 5 if name == "LASSO" else 7)


def test_nothing_published_later_reaches_a_reading(spark, world):
    """Values published after a reading, and prints from the quarter on, are changed; readings stay."""
    names = [r[0] for r in world["x"].select("ticket").distinct().orderBy("ticket").limit(4).collect()]
    s, m = spec(spark, "s", 4, 0, 3, 1, ["OLS"]), members(spark, names)
    t = dt.date(2001, 3, 1)

    def read(g, y):
        x = cells.carried(g, "2001-09-01")
        table = cells.coefficients(s, m, x, y, str(t), str(t))
        return {r["vintage"]: r["pred"] for r in cells.readings(table, x, world["lags"], vintage.target_lags(y.filter("y is not null"), 2, 1)).collect()}

    before = read(world["g"], world["y"])
    late = F.add_months("date", F.col("months_lag")) > F.add_months(F.lit(t), F.lit(0))
    g = world["g"].join(world["lags"], "ticket").select("ticket", "date", F.when(late, F.col("value") + 1000).otherwise(F.col("value")).alias("value"))
    y = world["y"].select("date", F.when(F.col("date") >= F.lit(t), F.col("y") * 7).otherwise(F.col("y")).alias("y"))
    after = read(g, y)
    for v in (-2, -1, 0):
        assert after[v] == pytest.approx(before[v], rel=1e-9)
    assert after[6] != pytest.approx(before[6], rel=1e-3)


def test_lines_equal_fitted_cells(spark, world):
    one = cells.lines(world["x"], world["y"]).filter(F.col("date") == FIRST)
    names = sorted({r["spec"] for r in one.collect()})[:3]
    for n in names:
        table = cells.coefficients(spec(spark, n, 1, 0, 1, 0, ["OLS"]), members(spark, [n]), world["x"], world["y"], FIRST, FIRST)
        a = {r["ticket"]: r["beta"] for r in one.filter(F.col("spec") == n).collect()}
        b = {r["ticket"]: r["beta"] for r in table.collect()}
        close(a, b)


def test_live_quarters_replay_the_grid(spark, world):
    """With the cut moved on month by month, the last quarter's models read what the grid says of that quarter."""
    names = [r[0] for r in world["x"].select("ticket").distinct().orderBy("ticket").limit(3).collect()]
    table = cells.coefficients(spec(spark, "s", 3, 0, 2, 0, ["OLS"]), members(spark, names), world["x"], world["y"], FIRST, FIRST)
    want = {r["vintage"]: r["pred"] for r in cells.readings(table, world["x"], world["lags"]).collect()}
    for cut, v in (("2001-01-01", -2), ("2001-03-01", 0), ("2001-04-01", 1), ("2001-07-01", 4)):
        at = cells.live_grid(world["y"], cut, 5, FIRST)
        got = {(str(r["date"]), r["vintage"]): r["pred"] for r in cells.readings(table, world["x"], world["lags"], at=at).collect()}
        assert got[FIRST, v] == pytest.approx(want[v], rel=1e-9)
    at = {(str(r["date"]), r["vintage"]) for r in cells.live_grid(world["y"], "2001-05-01", 5, "2001-12-01").collect()}
    assert at == {("2001-03-01", 2), ("2001-06-01", -1), ("2001-09-01", -4), ("2001-12-01", -7)}


def test_left_out_quarter_is_not_learned_from(spark, world):
    """The cell of a shock quarter equals a hand-made fit without it; changing its print changes only the actual."""
    names = [r[0] for r in world["x"].select("ticket").distinct().orderBy("ticket").limit(2).collect()]
    s, m, shock = spec(spark, "s", 2, 0, 1, 0, ["OLS", "OLSR"]), members(spark, names), "1999-06-01"
    a = {r["estimator"]: r for r in cells.left_out(s, m, world["x"], world["y"], shock, FIRST, world["lags"]).collect()}
    y2 = world["y"].withColumn("y", F.when(F.col("date") == shock, 500.0).otherwise(F.col("y")))
    b = {r["estimator"]: r for r in cells.left_out(s, m, world["x"], y2, shock, FIRST, world["lags"]).collect()}
    assert a.keys() == {"OLS", "OLSR"}
    for e in a:
        assert b[e]["predicted"] == pytest.approx(a[e]["predicted"], rel=1e-9) and b[e]["actual"] == 500.0
        assert a[e]["residual"] == pytest.approx(a[e]["predicted"] - a[e]["actual"])


def test_rankings_as_of_a_quarter(spark, world):
    """The latest ranking at or before the test quarter counts, the earliest one before the first."""
    names = [r[0] for r in world["x"].select("ticket").distinct().orderBy("ticket").limit(2).collect()]
    m = spark.createDataFrame([("m", dt.date(2001, 6, 1), names[0], 1), ("m", dt.date(2001, 9, 1), names[1], 1)], "method string, as_of date, ticket string, rank int")
    table = cells.coefficients(spec(spark, "s", 1, 0, 1, 0, ["OLS"]), m, world["x"], world["y"], FIRST)
    used = {(str(r["date"]), r["ticket"]) for r in table.collect() if r["ticket"] != cells.CONSTANT}
    assert used == {("2001-03-01", names[0]), ("2001-06-01", names[0]), ("2001-09-01", names[1])}


def test_design_rows_hold_what_lines_learn_from_and_read(spark, world):
    """A line fitted on the rows of a cell, applied to the rows of its vintages, gives that line's readings."""
    names = [r[0] for r in world["x"].select("ticket").distinct().orderBy("ticket").limit(3).collect()]
    s, m = spec(spark, "s", 3, 0, 2, 0, ["OLS"]), members(spark, names)
    table = cells.coefficients(s, m, world["x"], world["y"], FIRST, FIRST)
    want = {r["vintage"]: r["pred"] for r in cells.readings(table, world["x"], world["lags"]).collect()}
    rows = [r for r in cells.design_rows(s, m, world["x"], world["y"], world["lags"], FIRST).collect() if str(r["date"]) == FIRST]
    past, now = [r for r in rows if r["y"] is not None], {r["id"]: r["x"] for r in rows if r["y"] is None}
    past = sorted(past, key=lambda r: r["id"])
    first = min(r["id"] for r in past)
    past = [r for r in past if r["id"] > first or len(r["x"]) == 6]
    c, b = E.least_squares(np.array([r["x"] for r in past]), np.array([r["y"] for r in past]), np.array([r["w"] for r in past]))
    close({v: c + np.array(x) @ b for v, x in now.items()}, want)


def test_empty_tables(spark, world):
    none = world["x"].limit(0)
    assert cells.coefficients(spec(spark, "s", 1, 0, 1, 0, ["OLS"]), members(spark, ["a"]), none, world["y"], FIRST).count() == 0
    assert cells.carried(world["g"].limit(0)).count() == 0
    assert cells.lines(none, world["y"]).count() == 0


def sample(seed, n=40, p=12):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, p)) @ r.normal(size=(p, p))
    return x, x[:, 0] - 2 * x[:, 3] + r.normal(size=n), 0.95 ** np.arange(n)[::-1]


@pytest.mark.parametrize("shape", [(40, 12), (20, 30)])
def test_elastic_net_is_optimal_at_every_penalty(shape):
    """Slopes of the smooth part lie at the penalty where a coefficient is not zero, and within it where it is."""
    x, y, w = sample(1, *shape)
    z, _, _ = E.standardised(x)
    gram, cross, _, _ = E.moments(z, y, w)
    for ratio in (0.25, 1.0):
        beta = np.zeros((1, shape[1]))
        for a in E.penalties(cross, ratio):
            beta = E.descend(gram[None], cross[None], beta, np.array([a * ratio]), np.array([a * (1 - ratio)]))
            b = beta[0]
            slope = cross - gram @ b - a * (1 - ratio) * b
            on = b != 0
            assert np.abs(slope[on] - a * ratio * np.sign(b[on])).max(initial=0) < 1e-6
            assert (np.abs(slope) <= a * ratio + 1e-6).all()


def test_elastic_net_chooses_as_brute_force():
    x, y, w = sample(2, 30, 6)
    z, mean, sd = E.standardised(x)
    cross = E.moments(z, y, w)[1]
    best = None
    for ratio in (0.25, 0.5, 0.75):
        for a in E.penalties(cross, ratio):
            total = 0.0
            for learn, to in E.time_splits(len(y), 4):
                c, b = E.net_line(z[:learn], np.zeros(6), np.ones(6), y[:learn], w[:learn], ratio, a)
                total += w[learn:to] @ (y[learn:to] - c - z[learn:to] @ b) ** 2
            if best is None or total < best[0] - 1e-9:
                best = (total, ratio, a)
    c, b = E.net_line(z, mean, sd, y, w, best[1], best[2])
    got = E.elastic_net(x, y, w)
    assert got[0] == pytest.approx(c, abs=1e-5) and np.allclose(got[1], b, atol=1e-5)


def test_ridge_leaves_rows_out_exactly():
    x, y, w = sample(3, 25, 8)
    z, mean, sd = E.standardised(x)
    errors = []
    for alpha in E.ALPHAS:
        off = []
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            d = np.column_stack([np.ones(keep.sum()), z[keep]])
            p = np.diag([0.0] + [alpha] * 8)
            b = np.linalg.solve((d * w[keep, None]).T @ d + p, (d * w[keep, None]).T @ y[keep])
            off.append(w[i] * (y[i] - b[0] - z[i] @ b[1:]) ** 2)
        errors.append(np.mean(off))
    alpha = E.ALPHAS[int(np.argmin(errors))]
    d, p = np.column_stack([np.ones(len(y)), z]), np.diag([0.0] + [alpha] * 8)
    b = np.linalg.solve((d * w[:, None]).T @ d + p, (d * w[:, None]).T @ y)
    c, beta = E.ridge(x, y, w)
    assert np.allclose(beta, b[1:] / sd) and c == pytest.approx(b[0] - mean @ (b[1:] / sd))


def test_least_squares_is_weighted_and_shortest():
    x, y, w = sample(4)
    d = np.column_stack([np.ones(len(y)), x])
    b = np.linalg.solve((d * w[:, None]).T @ d, (d * w[:, None]).T @ y)
    c, beta = E.least_squares(x, y, w)
    assert c == pytest.approx(b[0]) and np.allclose(beta, b[1:])
    x, y, w = sample(5, 10, 15)
    c, beta = E.least_squares(x, y, w)
    assert np.allclose(c + x @ beta, y)


def test_design_grid(spark):
    rows = [("a", 3, 0.4), ("a", 6, 0.9), ("b", 4, 0.5)]
    got = [r for r in cells.designs(spark.createDataFrame(rows, "method string, size int, score double")).collect()]
    names = {r["spec"] for r in got}
    assert len(names) == len(got) and names == {"bench3", "bench3flats", "a6", "a6flats", "a6p5", "a6p3", "a6p5l2", "b4", "b4flats", "b4p3"}
    assert {(r["factors"], r["flat"], r["lags"]) for r in got if r["spec"] == "a6p5l2"} == {(5, 3, 2)}


def test_only_asked_tickets_are_carried(spark):
    """On the calendar of all tickets, as if all had been carried."""
    rows = [(f"S{k}", f"{2000 + k // 3}-0{m}-01", float(k * m)) for k in range(9) for m in range(1, 10) if (k + m) % 4]
    g = spark.createDataFrame(rows, "ticket string, date string, value double").withColumn("date", F.to_date("date"))
    of = spark.createDataFrame([("S4",), ("S4",), ("S5",), ("S99",)], "ticket string")
    want = cells.carried(g, "2003-03-01").filter("ticket in ('S4', 'S5')")
    got = cells.carried(g, "2003-03-01", of=of)
    assert got.count() == 2 * 39 and sorted(got.collect()) == sorted(want.collect())
