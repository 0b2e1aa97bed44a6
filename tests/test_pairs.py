import datetime
import random

import numpy as np
import pyarrow as pa

from tests.conftest import SF
from tidemark.operators import panel, preparation, screens
from tidemark.plans import cell_queries, selection_queries


def test_all_pairs_in_blocks(spark):
    """Every pair against brute force: gaps, series that do not vary, a pair without common dates, several blocks."""
    rng, rows = random.Random(2), []
    for k in range(23):
        for t in range(20):
            if rng.random() < 0.7 and (k > 1 or t % 2 == k):
                rows.append((f"S{k * 37:07d}", datetime.date(2000 + t, 3, 1), 4.2 if k == 5 else rng.gauss(k, 3)))
    series = {}
    for s, d, v in rows:
        series.setdefault(s, {})[d] = v
    want = {}
    for a in series:
        for b in series:
            common = sorted(series[a].keys() & series[b].keys())
            if a < b and common:
                x, y = ([series[s][d] for d in common] for s in (a, b))
                r = None if len(set(x)) == 1 or len(set(y)) == 1 else float(np.corrcoef(x, y)[0, 1])
                want[a, b] = (len(common), None if r is None else round(r, 9))
    df = spark.createDataFrame(rows, "ticket string, date date, value double")
    for block in (4, 64):
        got = [(r["a"], r["b"], r["n"], None if r["r"] is None else round(r["r"], 9)) for r in panel.pair_correlations(df, block).collect()]
        assert len(got) == len(want) == 23 * 22 // 2 - 1
        assert {(a, b): (n, r) for a, b, n, r in got} == want


def test_only_near_pairs_leave_and_digits_stay(spark):
    """Series that hardly vary on common dates beside one large value elsewhere, infinite values, and a least |r|."""
    rng, rows = np.random.default_rng(3), []
    for k in range(40):
        v = rng.normal(0, 1, 12) + (rng.normal(0, 1, 12) if k % 2 else 0)
        if k < 10:
            v[k] = 1e9 * (k + 1)
        if k == 11:
            v[3] = np.inf
        rows += [(f"S{k:02d}", datetime.date(2000 + t, 3, 1), float(x)) for t, x in enumerate(v) if t != (k * 7 + 1) % 12 and t != (k * 5 + 2) % 12]
    series = {}
    for s, d, v in rows:
        series.setdefault(s, {})[d] = v
    want = {}
    for a in series:
        for b in series:
            common = sorted(series[a].keys() & series[b].keys())
            if a < b and np.isfinite([series[s][d] for s in (a, b) for d in common]).all():
                want[a, b] = float(np.corrcoef(*([series[s][d] for d in common] for s in (a, b)))[0, 1])
    df = spark.createDataFrame(rows, "ticket string, date date, value double")
    got = {(r["a"], r["b"]): r["r"] for r in panel.pair_correlations(df).collect()}
    assert len(got) == 780 and all(np.isclose(got[p], r, atol=1e-9) for p, r in want.items())
    assert all(r is None for p, r in got.items() if p not in want)
    near = {(r["a"], r["b"]) for r in panel.pair_correlations(df, least=0.4).collect()}
    assert near == {p for p, r in want.items() if abs(r) >= 0.4}


def test_walk_meets_kept_series_only(spark, monkeypatch):
    """The walk over series gives what the walk over all pairs gives: several blocks, ties, gaps, copies, series without values."""
    rng, rows, scores = np.random.default_rng(7), [], []
    base = rng.normal(0, 1, (12, 8))
    for k in range(90):
        v = base[k % 12] + rng.normal(0, 0.5, 8) if k % 9 else base[k % 12]
        scores.append((f"S{k:02d}", float(rng.integers(0, 10))))
        rows += [(f"S{k:02d}", datetime.date(2000 + t, 3, 1), float(x)) for t, x in enumerate(v) if t != k % 11 and k != 50]
    df, s = spark.createDataFrame(rows, "ticket string, date date, value double"), spark.createDataFrame(scores, "ticket string, score double")
    want = sorted(map(tuple, screens.pruned(s, panel.pair_correlations(df), 0.8).collect()))
    monkeypatch.setattr(panel, "pair_correlations", None)
    for block in (24, 2048):
        assert sorted(map(tuple, screens.pruned_along(s, df, 0.8, block).collect())) == want
    assert 12 <= len(want) < 80 and screens.pruned_along(s.limit(0), df, 0.8).count() == 0
    assert selection_queries.d12(spark, SF).count() > 0


def test_one_of_near_series_goes_without_a_table_of_pairs(spark, monkeypatch):
    """The rounds over series give what the walk over all pairs gives: several rounds, ties, gaps, copies."""
    rng, rows, facts = np.random.default_rng(9), [], []
    base = rng.normal(0, 1, (12, 8))
    for k in range(90):
        v = base[k % 12] + rng.normal(0, 0.5, 8) if k % 9 else base[k % 12]
        facts.append((f"S{k:02d}", bool(rng.integers(0, 4) == 0), int(rng.integers(7, 10))))
        rows += [(f"S{k:02d}", datetime.date(2000 + t, 3, 1), float(x)) for t, x in enumerate(v) if t != k % 11]
    df, f = spark.createDataFrame(rows, "ticket string, date date, value double"), spark.createDataFrame(facts, "ticket string, aggregate boolean, length long")
    want = sorted(map(tuple, preparation.deduped(f, panel.pair_correlations(df), 0.6).collect()))
    monkeypatch.setattr(panel, "pair_correlations", None)
    for block in (13, 4096):
        assert sorted(map(tuple, preparation.deduped_along(f, df, 0.6, block).collect())) == want
    assert 40 < len(want) < 90 and preparation.deduped_along(f.limit(0), df, 0.6).count() == 0
    assert cell_queries.d13(spark, SF).count() > 0


def test_pairs_of_a_block_leave_in_parts():
    """Blocks are large, so that series are sent to few; what a task holds does not grow with the square of its block."""
    rng, n = np.random.default_rng(3), 300
    t = pa.table({"i": [0] * n, "j": [0] * n, "block": pa.array([0] * n, pa.int32()), "ticket": [f"S{k:03d}" for k in range(n)], "date": [list(range(6))] * n, "value": rng.normal(0, 1, (n, 6)).tolist()})
    parts = list(panel._block_correlations(t, None))
    assert len(parts) == 3 and sum(len(b) for b in parts) == n * (n - 1) // 2
