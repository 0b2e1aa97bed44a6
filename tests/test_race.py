"""The path of least angles and the race against plain loops on whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import cells, race, screens
from tidemark.plans.queries import TEST, _growths


@pytest.fixture(scope="module")
def world(spark):
    g, y = _growths(spark, SF)
    p = cells.carried(g.withColumnRenamed("growth", "value"), "2001-09-01", 3)
    rows = race.quarterly_rows(p)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    known = {r["date"]: r["growth"] for r in y.collect() if r["growth"] is not None}
    return {"rows": rows, "quarters": race.calendar(p), "known": known, "g": g, "y": y}


def plain_lars(x, y, names, most):
    """Textbook path on the whole matrix: step to where the next correlation reaches the active ones'."""
    r = y - y.mean()
    active, order, levels = [], [], []
    c = x.T @ r
    j = max(range(len(names)), key=lambda k: (round(abs(c[k]), 12), [-ord(ch) for ch in names[k]]))
    active.append(j)
    while True:
        c = x.T @ r
        top = np.abs(c[active]).max()
        assert np.allclose(np.abs(c[active]), top)  # equal angles along the path
        order.append(names[active[-1]])
        levels.append(top)
        if len(order) == most:
            return order, levels
        s = np.sign(c[active])
        xa = x[:, active] * s
        ginv = np.linalg.inv(xa.T @ xa)
        a = 1 / np.sqrt(ginv.sum())
        u = xa @ (a * ginv.sum(1))
        best = None
        for k in range(len(names)):
            if k not in active:
                b = x[:, k] @ u
                for step in ((top - c[k]) / (a - b), (top + c[k]) / (a + b)):
                    if step > 1e-12 and (best is None or step < best[0]):
                        best = (step, k)
        r = r - best[0] * u
        active.append(best[1])


def test_entry_order_equals_plain_path(spark, world):
    tests = [q for q in world["quarters"] if str(q) in ("2000-12-01", "2001-03-01")]
    got = {}
    for r in race.entry_order(world["rows"], world["quarters"], world["known"], tests, 8).collect():
        got.setdefault(r["as_of"], []).append((r["rank"], r["ticket"], r["score"]))
    for t in tests:
        z = {r["ticket"]: np.array(r["x"]) for r in race.standard_rows(world["rows"], world["quarters"], world["known"], [t]).collect()}
        names = sorted(z)
        y = np.array([world["known"][q] for q in world["quarters"] if q < t and q in world["known"]])
        order, levels = plain_lars(np.column_stack([z[n] for n in names]), y, names, 8)
        assert [n for _, n, _ in sorted(got[t])] == order
        assert np.allclose([s for _, _, s in sorted(got[t])], levels)
        assert all(a >= b for a, b in zip(levels, levels[1:], strict=False))


def test_copies_are_passed_over(spark, world):
    """A second copy of every series is in the span of the first and never enters; ties go by ticket."""
    rows = world["rows"]
    twice = rows.unionByName(rows.withColumn("ticket", F.concat("ticket", F.lit("z"))))
    t = [q for q in world["quarters"] if str(q) == "2001-03-01"]
    a = [r["ticket"] for r in race.entry_order(rows, world["quarters"], world["known"], t, 4).orderBy("rank").collect()]
    b = [r["ticket"] for r in race.entry_order(twice, world["quarters"], world["known"], t, 4).orderBy("rank").collect()]
    assert a == b


def test_no_rows(spark, world):
    t = [q for q in world["quarters"] if str(q) == "2001-03-01"]
    assert race.entry_order(world["rows"].limit(0), world["quarters"], world["known"], t, 4).count() == 0


def test_race_equals_plain_loop(spark, world):
    """Every fold and size anew: standardise, clip, principal components, line, error."""
    rows = {r["ticket"]: (np.array(r["x"]), np.array(r["seen"])) for r in world["rows"].collect()}
    y = np.array([world["known"].get(q, np.nan) for q in world["quarters"]])[1:]
    cut = world["rows"].select("ticket", F.slice("x", 2, 1000).alias("x"), F.slice("seen", 2, 1000).alias("seen"))
    names = sorted(rows)
    rankings = spark.createDataFrame([("m", n, i + 1) for i, n in enumerate(names[:12])] + [("k", n, i + 1) for i, n in enumerate(names[30:36])], "method string, ticket string, rank int")
    got = {(r["method"], r["size"]): (r["mse"], r["ratio"]) for r in race.race(rankings, cut, y, (3, 12), 4, clip=1.5).collect()}

    def plain(tickets):
        errors = []
        for s in race.fold_starts(len(y)):
            use = [t for t in tickets if rows[t][1][1:][s - 1] >= 8]
            x = np.column_stack([rows[t][0][1:][: s + 4] for t in use])
            z = np.clip((x - x[:s].mean(0)) / x[:s].std(0), -1.5, 1.5)
            m = z[:s].mean(0)
            axes = np.linalg.svd(z[:s] - m, full_matrices=False)[2][: min(4, len(use))]
            d = np.column_stack([np.ones(s + 4), (z - m) @ axes.T])
            b = np.linalg.lstsq(d[:s], y[:s], rcond=None)[0]
            errors.append(((y[s : s + 4] - d[s:] @ b) ** 2).mean())
        return np.mean(errors)

    whole = plain(names)
    assert {k for m, k in got if m == "m"} == set(range(3, 13)) and {k for m, k in got if m == "k"} == {3, 4, 5, 6}
    for (m, k), (mse, ratio) in got.items():
        want = plain(names[:k] if m == "m" else names[30 : 30 + k])
        assert mse == pytest.approx(want, rel=1e-6) and ratio == pytest.approx(want / whole, rel=1e-6)


def test_rolling_t_statistics_equal_single_ones(spark, world):
    tests = world["y"].filter(F.col("date") >= TEST).select(F.col("date").alias("as_of"))
    rolling = screens.rolling_t_statistics(world["g"], world["y"], tests).filter(F.col("as_of") == "2001-03-01")
    a = {r["ticket"]: r["score"] for r in rolling.collect()}
    b = {r["ticket"]: r["score"] for r in screens.t_statistics(world["g"], world["y"], "2001-03-01").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)
