"""Parts that narrow work down before one task sees it."""

import numpy as np
import pytest

from tidemark.operators import panel, preparation, vintage


@pytest.mark.parametrize("kind", ["spread", "ties", "outliers"])
def test_exact_percentile(spark, kind):
    rng = np.random.default_rng(4)
    v = {"spread": rng.standard_normal(20_000), "ties": rng.integers(0, 5, 20_000).astype(float), "outliers": np.r_[rng.standard_normal(19_990), [1e12] * 10]}[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "value double")
    for share in (0.0, 0.25, 0.9, 0.99999, 1.0):
        assert np.isclose(panel.exact_percentile(df, "value", share, most=50), np.quantile(v, share), rtol=1e-9)
    assert panel.exact_percentile(df.limit(0), "value", 0.5) is None
    assert panel.capped(df.limit(0)).count() == 0


def test_ranks_run_through(spark):
    """Ranks are those of one sorted list; equal scores go by ticket."""
    rng = np.random.default_rng(6)
    y = rng.standard_normal(12)
    g = [(f"S{i:03d}", f"2000-{m + 1:02d}-01", float(round(x, 1))) for i in range(120) for m, x in enumerate(y * rng.uniform(-1, 1) + rng.standard_normal(12))]
    g += [(f"T{t[1:]}", d, v) for t, d, v in g]
    growth = spark.createDataFrame(g, "ticket string, date string, growth double").withColumn("date", vintage.F.to_date("date"))
    target = spark.createDataFrame([(f"2000-{m + 1:02d}-01", float(v)) for m, v in enumerate(y)], "date string, growth double").withColumn("date", vintage.F.to_date("date"))
    out = vintage.screened(growth, target, "2001-01-01").collect()
    assert [r["rank"] for r in sorted(out, key=lambda r: (-r["score"], r["ticket"]))] == list(range(1, 241))


def test_months_are_dealt_over_all_parts(spark):
    obs = spark.range(2000).selectExpr("concat('S', id % 200) as ticket", "add_months(date'2000-01-01', cast(id div 200 as int)) as date", "cast(id as double) as value")
    kinds = obs.select("ticket").distinct().withColumn("frequency", vintage.F.lit("monthly"))
    out = panel.to_months(obs, kinds)
    assert out.count() == 2000 and out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_of_series_are_not_broadcast(spark):
    """Spark sizes exploded rows as the packed table they come from: no join may broadcast them for that."""
    obs = spark.range(60 * 40).selectExpr("concat('S', id % 60) as ticket", "add_months(date'2000-01-01', cast(id div 60 as int)) as date", "cast(id % 60 % 50 + 1 as double) as value")
    plan = preparation.duplicates(obs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin [one" in x or "BroadcastHashJoin [two" in x]
