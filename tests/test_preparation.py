"""Duplicates near zero, the walk over correlated pairs, compressed lags, long exports."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemark.operators import compression, panel, preparation
from tidemark.sources import files

DAYS = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(40)]


def found(spark, series):
    rows = [(n, d, v) for n, vs in series.items() for d, v in zip(DAYS, vs, strict=False) if v is not None]
    return {r["ticket"]: r["copy_of"] for r in preparation.duplicates(spark.createDataFrame(rows, "ticket string, date date, value double")).collect()}


def test_duplicates_near_zero(spark):
    a = [float(i) if i < 15 else 0.0 for i in range(30)]
    assert found(spark, {"a": a, "b": [v if i < 15 else 8e-10 for i, v in enumerate(a)]}) == {"b": "a"}
    assert found(spark, {"a": [v or 3e-10 for v in a], "b": [v or -3e-10 for v in a]}) == {"b": "a"}
    assert found(spark, {"a": a, "b": [v if i < 29 else 3e-9 for i, v in enumerate(a)]}) == {}


def test_duplicates_of_sparse_series(spark):
    """Zeros on most dates, which every series shares; copies differ by rounding, others on one date."""
    r = random.Random(3)
    base = {f"s{k:02}": [r.choice([0.0, 0.0, 0.0, -1.5, 1e6 * r.random()]) for _ in range(40)] for k in range(12)}
    every = dict(base) | {f"t{k}": [v * (1 + 5e-7) for v in base[k]] for k in ("s03", "s07")} | {"u": [v + (0.01 if i == 39 else 0) for i, v in enumerate(base["s05"])]}
    every["short"] = base["s01"][:23]
    every["late"] = [None] * 10 + base["s02"][10:]
    want = {}
    for b in sorted(every):
        for a in sorted(every):
            if a < b and b not in want:
                both = [(x, y) for x, y in zip(every[a], every[b], strict=False) if x is not None and y is not None]
                if len(both) >= 24 and all(abs(x - y) <= 1e-9 + 1e-6 * abs(y) for x, y in both):
                    want[b] = a
    assert want and found(spark, every) == want


def plain_walk(facts, pairs, most):
    gone = {}
    for b in sorted(facts):
        for a in sorted(facts):
            if a < b and abs(pairs.get((a, b), 0)) > most and b not in gone and a not in gone:
                if facts[b] >= facts[a]:
                    gone[a] = b
                else:
                    gone[b] = a
    return gone


def test_correlated_pairs_equal_plain_walk(spark):
    """Many small tables side by side: names begin with the number of their table, and no pair crosses tables."""
    r = random.Random(4)
    facts, pairs = {}, {}
    for t in range(200):
        names = [f"{t:03}{k}" for k in range(r.randint(1, 7))]
        facts |= {n: (int(r.random() < 0.3), r.randint(1, 3)) for n in names}
        pairs |= {(a, b): r.uniform(-1, 1) for a in names for b in names if a < b and r.random() < 0.8}
    got = preparation.deduped(
        spark.createDataFrame([(n, bool(g), k) for n, (g, k) in facts.items()], "ticket string, aggregate boolean, length long"), spark.createDataFrame([(a, b, v) for (a, b), v in pairs.items()], "a string, b string, r double"), 0.4
    )
    assert {x["ticket"]: x["dropped_for"] for x in got.collect()} == plain_walk(facts, pairs, 0.4)


def test_no_pairs(spark):
    none = spark.createDataFrame([], "a string, b string, r double")
    assert preparation.deduped(spark.createDataFrame([("a", True, 1)], "ticket string, aggregate boolean, length long"), none).count() == 0


@pytest.mark.parametrize(("lags", "degree"), [(6, 2), (12, 3), (2, 2), (1, 0)])
def test_basis_is_orthogonal(lags, degree):
    b = compression.legendre(lags, degree)
    assert np.allclose(b @ b.T, np.eye(len(b))) and len(b) == min(degree + 1, lags)
    if lags > 2:  # spans the same polynomials
        at = np.linspace(-1, 1, lags)
        for k in range(len(b)):
            p = at**k
            assert np.allclose(b.T @ (b @ p), p)


def test_compressed_columns_equal_numpy(spark):
    v = np.random.default_rng(1).normal(size=12)
    x = spark.createDataFrame([("a", d, float(k)) for d, k in zip(DAYS, v, strict=False)] + [("b", DAYS[11], 1.0)], "ticket string, date date, value double")
    got = {(r["ticket"], r["power"]): r["value"] for r in compression.compressed(x, spark.createDataFrame([(DAYS[11],)], "date date"), 6).collect()}
    assert got.keys() == {("a", 0), ("a", 1), ("a", 2)} and np.allclose([got["a", k] for k in range(3)], compression.legendre(6) @ v[11:5:-1])


def test_months_before_the_first_year_have_no_date(spark):
    rows = [("a", 1, "November", None, 1.0), ("a", 2, "December", None, 2.0), ("a", 3, "January", 1995, 3.0), ("a", 4, "February", None, 4.0), ("b", 1, "May", None, 5.0)]
    got = files.named_months(spark.createDataFrame(rows, "ticket string, line int, month string, year int, value double"))
    assert {r["value"]: r["date"] for r in got.collect()} == {1.0: None, 2.0: None, 3.0: dt.date(1995, 1, 1), 4.0: dt.date(1995, 2, 1), 5.0: None}


def test_minimum_at_the_bound_is_not_below_it(spark):
    """Series whose last quarter lies exactly at mean - 1.5 sd of 20 whole numbers, against whole-number arithmetic."""
    x = np.random.default_rng(1).normal(100, 28, (400_000, 20)).round().astype(np.int64)
    total, spread = x.sum(1), 20 * (x * x).sum(1) - x.sum(1) ** 2
    off = np.sqrt(180 * spread / 76).round().astype(np.int64)
    at = np.flatnonzero((76 * off**2 == 180 * spread) & ((total - off) % 20 == 0))
    assert len(at) > 20
    rows, want = [], [0] * 21
    for k in at:
        v = [*x[k].tolist(), int(total[k] - off[k]) // 20]
        rows += [(f"S{k}", dt.date(1995 + i // 4, i % 4 * 3 + 3, 1), float(u)) for i, u in enumerate(v)]
        for i, u in enumerate(v):
            want[i] += bool(total[k] > 20 * u and 76 * (total[k] - 20 * u) ** 2 > 180 * spread[k])
    got = panel.shock_quarters(spark.createDataFrame(rows, "ticket string, date date, value double"), "2000-01-01", 1.5).orderBy("date").collect()
    assert [r["broken"] for r in got] == want and want[-1] == 0


def test_few_series_meet_unless_equal(spark):
    """Whole numbers that many series share on each date: beside the equal ones, next to no pairs are compared."""
    rng = random.Random(5)
    series = {f"S{k:03d}": [float(rng.randint(1, 40)) if rng.random() < 0.95 else None for _ in range(40)] for k in range(300)}
    near = {f"T{k:03d}": [v and v * (1 + 1e-8 * rng.choice((-1, 1))) for v in series[f"S{k:03d}"]] for k in range(20)}
    copies = {f"U{k:03d}": series["S007"] for k in range(50)}
    rows = [(n, d, v) for n, vs in (series | near).items() for d, v in zip(DAYS, vs, strict=False) if v is not None]
    met = {tuple(r) for r in preparation.meeting(spark.createDataFrame(rows, "class string, date date, value double"), 24).collect()}
    assert met >= {(f"S{k:03d}", f"T{k:03d}") for k in range(20)} and len(met) < 60
    want = {f"T{k:03d}": f"S{k:03d}" for k in range(20)} | {n: "S007" for n in copies}
    assert found(spark, series | near | copies) == want


def test_long_calendar_meets_by_single_dates(spark):
    rng = random.Random(6)
    a = [rng.gauss(0, 1) for _ in range(400)]
    b = [v if i % 10 == 0 else None for i, v in enumerate(a)]
    days = [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(400)]
    rows = [(n, d, v) for n, vs in {"a": a, "b": b, "c": a[::-1]}.items() for d, v in zip(days, vs, strict=True) if v is not None]
    out = preparation.duplicates(spark.createDataFrame(rows, "ticket string, date date, value double"), 24).collect()
    assert [tuple(r) for r in out] == [("b", "a")]


def test_one_series_with_many_pairs_takes_few_rounds(spark, monkeypatch):
    """A walk along one series' pairs, and a random one, against the plain walk."""
    rounds, write = [], preparation.written
    monkeypatch.setattr(preparation, "written", lambda df: rounds.append(1) or write(df))
    rng = random.Random(8)
    names = [f"S{k:03d}" for k in range(60)]
    for pairs, most in (([(n, "S060", 0.9) for n in names], 4), ([(a, b, -0.9) for a in names for b in names if a < b and rng.random() < 0.15], 12)):
        facts = {n: (rng.random() < 0.1, rng.randint(3, 5)) for n in [*names, "S060"]}
        gone = {}
        for b, a in sorted((b, a) for a, b, _ in pairs):
            if a not in gone and b not in gone:
                out = a if facts[b] >= facts[a] else b
                gone[out] = b if out == a else a
        rounds.clear()
        got = preparation.deduped(spark.createDataFrame([(n, *f) for n, f in facts.items()], "ticket string, aggregate boolean, length long"), spark.createDataFrame(pairs, "a string, b string, r double"))
        assert {r["ticket"]: r["dropped_for"] for r in got.collect()} == gone and len(rounds) <= most
