"""Queries that fit cells: orders of entry, the race, design grids, sparse lines, readings of lines and trees, live readings."""

from __future__ import annotations

import datetime as dt
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import cells, compression, panel, preparation, race, screens, trees, vintage
from tidemark.plans.queries import _SCREEN, TEST, _growths, query, rounded
from tidemark.plans.selection_queries import _T
from tidemark.sources.files import written
from tidemark.testbed import meta, obs

SIZES = (4, 6)


def _y(s: SparkSession, d: str) -> DataFrame:
    return _growths(s, d)[1].withColumnRenamed("growth", "y")


def months(s: SparkSession, d: str, until: str, of: DataFrame) -> DataFrame:
    """Monthly growth of the suppliers in `of`, few, carried on to a month, on the calendar of all suppliers."""
    return written(cells.carried(panel.monthly_growth(written(obs(s, d))).withColumnRenamed("growth", "value"), until, of=of))


def _quarters(s: SparkSession, d: str):
    """Rows of the quarterly panel, its calendar, the target by quarter, and the test quarters."""
    g, y = _growths(s, d)
    p = written(cells.carried(g.withColumnRenamed("growth", "value"), str(y.agg(F.max("date")).first()[0]), 3))
    known = {r["date"]: r["growth"] for r in y.filter("growth is not null").collect()}
    quarters = race.calendar(p)
    return race.quarterly_rows(p), quarters, known, [q for q in quarters if str(q) >= TEST]


def members(s: SparkSession, d: str, keep: int = 40) -> DataFrame:
    """(method, ticket, rank) of the correlation and the t-statistic screen before the first test quarter."""
    g, y = (written(x) for x in _growths(s, d))
    one = s.createDataFrame([(dt.date.fromisoformat(TEST),)], "as_of date")
    t = race.ranked(rounded(screens.rolling_t_statistics(g, y, one), "score"), keep).select(F.lit("tstat").alias("method"), "ticket", "rank")
    return written(vintage.screened(g, y, TEST).filter(F.col("rank") <= keep).select(F.lit("sis").alias("method"), "ticket", "rank").unionByName(t))


@query("m05_entry_order", None)
def m05(s, d):
    """Series in order of entry on the path of least angles, before each test quarter."""
    rows, quarters, known, tests = _quarters(s, d)
    return rounded(race.entry_order(rows, quarters, known, tests, 15), "score")


@query("m06_attribution_order", None)
def m06(s, d):
    """Of the first 40 series of the correlation screen, mean absolute attribution in 300 boosted trees of depth two."""
    rows, quarters, known, _ = _quarters(s, d)
    first = members(s, d).filter("method = 'sis'").select("ticket")
    use = [(i + 1, q, known[q]) for i, q in enumerate(quarters) if str(q) < TEST and q in known]
    x = rows.join(first, "ticket", "left_semi").groupBy().agg(F.array_sort(F.collect_list(F.struct("ticket", "x"))).alias("m"))
    names = x.select(F.posexplode(F.transform("m", lambda r: r["ticket"])).alias("feature", "ticket"))
    at = s.createDataFrame([(i, (q - cells.EPOCH).days, v) for i, q, v in use], "i int, id long, y double")
    x = x.join(F.broadcast(at)).select(F.lit("all").alias("cell"), "id", "y", F.lit(1.0).alias("w"), F.transform("m", lambda r: F.element_at(r["x"], F.col("i"))).alias("x"))
    x = written(x)
    score = trees.attributed(trees.grown(x, trees.ATTRIBUTED), x)
    return score.join(names, "feature").select("ticket", F.round("score", 6).alias("score"), F.row_number().over(W.partitionBy("cell").orderBy(F.desc("score"), "ticket")).alias("rank"))


@query("m08_race", None)
def m08(s, d):
    """Error over expanding folds of every size of the screens, over that of all series."""
    rows, quarters, known, _ = _quarters(s, d)
    y = np.array([known.get(q, np.nan) for q in quarters if str(q) < TEST])
    path = race.entry_order(rows, quarters, known, [dt.date.fromisoformat(TEST)], 15).select(F.lit("lars").alias("method"), "ticket", "rank")
    skip = int(np.isnan(y[:1]).sum())  # the first quarter has no growth
    rows = rows.select("ticket", F.slice("x", 1 + skip, len(y) - skip).alias("x"), F.slice("seen", 1 + skip, len(y) - skip).alias("seen"))
    return rounded(race.race(members(s, d).unionByName(path), written(rows), y[skip:], (5, 40)), "mse", "ratio")


@query("m10_rolling_screens", None)
def m10(s, d):
    """Three screens anew before each test quarter: correlation, t statistics, order of entry."""
    g, y = _growths(s, d)
    tests = y.filter(F.col("date") >= F.to_date(F.lit(TEST))).select(F.col("date").alias("as_of"))
    sis = screens.rolling_screen(g, y, TEST, 15)
    t = race.ranked(rounded(screens.rolling_t_statistics(g, y, tests), "score"), 15)
    named = lambda x, n: x.select(F.lit(n).alias("method"), "as_of", "ticket", "score", "rank")
    return named(sis, "sis").unionByName(named(t, "tstat")).unionByName(named(m05(s, d), "lars"))


def groups(m: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(method, size, score): prefixes of the screens' members; the score falls with the mean rank in both screens together."""
    both = m.groupBy("ticket").agg(F.count("*").alias("screens"))
    x = m.join(both, "ticket").withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).filter(F.col("rank") <= F.col("size"))
    return x.groupBy("method", "size").agg((1 / F.sum("screens")).alias("score"))


_MEMBERS = _SCREEN + _T + """, members AS (SELECT 'sis' AS method, ticket, rank FROM ranked WHERE rank <= 40 UNION ALL SELECT 'tstat', ticket, rank FROM (SELECT ticket, row_number() OVER (ORDER BY score DESC, ticket) AS rank FROM tstat) WHERE rank <= 40),
grp AS (SELECT method, size, 1 / sum(screens) AS score FROM (SELECT *, unnest([4, 6]) AS size FROM members JOIN (SELECT ticket, count(*) AS screens FROM members GROUP BY 1) USING (ticket)) WHERE rank <= size GROUP BY 1, 2),
best AS (SELECT method, size FROM grp ORDER BY score, method, size LIMIT 1)"""


@query(
    "m13_designs",
    _MEMBERS + """ SELECT CASE WHEN (g.method, g.size) = (SELECT (method, size) FROM best) THEN 'bench' ELSE g.method END || g.size || design AS spec, g.method, g.size, factors, flat, lags, 'OLS OLSR ENET LASSO' AS estimators
FROM grp g, (VALUES ('', 0, 3, 0), ('flats', 0, 4, 0), ('p5', 5, 3, 0), ('p3', 3, 3, 0), ('p5l2', 5, 3, 2)) AS t(design, factors, flat, lags) WHERE factors = 0 OR factors < g.size""",
)
def m13(s, d):
    """Every group in every design."""
    return cells.designs(groups(members(s, d))).withColumn("estimators", F.array_join("estimators", " "))


def _cells(s: SparkSession, d: str):
    m, y = members(s, d), written(_y(s, d))
    return cells.designs(groups(m)), m, months(s, d, str(y.agg(F.max("date")).first()[0]), m), y


@query("m16_elastic_net", None)
def m16(s, d):
    """Sparse lines of each group's three months at the first test quarter, with the terms they keep."""
    specs, m, x, y = _cells(s, d)
    sparse = specs.filter("factors = 0 and flat = 3").withColumn("estimators", F.array(F.lit("ENET"), F.lit("LASSO")))
    table = cells.coefficients(sparse, m, x, y, TEST, TEST)
    return rounded(table.filter((F.col("beta") != 0) | (F.col("ticket") == cells.CONSTANT)).select("spec", "estimator", "ticket", "lag", "beta"), "beta", places=5)


def lines_table(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    specs, m, x, y = _cells(s, d)
    return written(cells.coefficients(specs, m, x, y, TEST)), x, y


@query("m18_readings", None)
def m18(s, d):
    """Readings of every test quarter, vintage, specification and line."""
    table, x, y = lines_table(s, d)
    r = cells.readings(table, x, meta(s, d), vintage.target_lags(y.filter("y is not null"), 2, 2))
    return r.join(F.broadcast(y.withColumnRenamed("y", "actual")), "date").select("date", "vintage", "spec", "estimator", F.round("pred", 5).alias("pred"), F.round("actual", 6).alias("actual"))


@query("m17_tree_readings", None)
def m17(s, d):
    """Readings of trees, forests and boosted trees of the raw designs."""
    specs, m, x, y = _cells(s, d)
    rows = written(cells.design_rows(specs.filter("flat = 3"), m, x, y, meta(s, d), TEST))
    out = None
    for name, g in (("DT", trees.TREE), ("DT4", trees.TREE4), ("RF", trees.FOREST), ("GBT", trees.BOOST)):
        r = trees.readings(trees.grown(rows, g), rows.filter("y is null")).withColumn("estimator", F.lit(name))
        out = r if out is None else out.unionByName(r)
    named = rows.filter("y is null").select("cell", "id", "spec", "date")
    return out.join(named, ["cell", "id"]).select("date", F.col("id").cast("int").alias("vintage"), "spec", "estimator", F.round("pred", 5).alias("pred"))


@query("m19_cell_residuals", None)
def m19(s, d):
    """Each line refitted without the target's worst quarter before the tests, and its error there."""
    specs, m, x, y = _cells(s, d)
    low = y.filter((F.col("date") < F.to_date(F.lit(TEST))) & (F.col("date") >= F.to_date(F.lit("1996-06-01")))).agg(F.min_by("date", "y")).first()[0]
    last = y.filter("y is not null").agg(F.max("date")).first()[0]
    return rounded(cells.left_out(specs, m, x, y, str(low), str(last), meta(s, d)), "actual", "predicted", "residual", places=5)


@query("m20_live_readings", None)
def m20(s, d):
    """Quarters without a print at the cut, read with the last fitted lines."""
    specs, m, _, y = _cells(s, d)
    cut, printed = "2001-07-01", "2001-03-01"
    known = y.filter(F.col("date") <= F.to_date(F.lit(printed)))
    x = written(cells.carried(panel.monthly_growth(obs(s, d).filter(F.col("date") <= F.to_date(F.lit(cut)))).withColumnRenamed("growth", "value"), "2001-12-01", of=m))
    table = written(cells.coefficients(specs, m, x, known, printed, printed))
    at = cells.live_grid(known, cut, 2, "2001-12-01").filter(F.col("date") > F.to_date(F.lit(printed)))
    p = known.filter("y is not null").select(F.col("date").alias("p"), "y")
    own = at.join(F.broadcast(p), F.add_months("p", 2) <= F.to_date(F.lit(cut))).withColumn("l", F.row_number().over(W.partitionBy("date", "vintage").orderBy(F.desc("p")))).filter("l <= 2")
    return rounded(cells.readings(table, x, meta(s, d), own.select("date", "vintage", "l", "y"), at), "pred", places=5)


def _tree_rows(s: SparkSession, d: str) -> DataFrame:
    specs, m, x, y = _cells(s, d)
    return written(cells.design_rows(specs.filter("flat = 3"), m, x, y, meta(s, d), TEST))


@query("m24_out_of_bag", None)
def m24(s, d):
    """Out-of-bag score of each raw cell's forest."""
    return rounded(trees.out_of_bag(_tree_rows(s, d), trees.FOREST), "r2")


@query("m24_staged_errors", None)
def m24_staged(s, d):
    """Error in the sample after each boosted tree."""
    rows = _tree_rows(s, d)
    return rounded(trees.staged(trees.grown(rows, trees.BOOST), rows), "mse")


@query("m24_importances", None)
def m24_importances(s, d):
    """What each term's splits take off the error of the forests, adding up to 1 in a cell."""
    return rounded(trees.importances(trees.grown(_tree_rows(s, d), trees.FOREST)), "importance")


LAGS, DEGREE = 6, 2
_BASIS = ", ".join(f"({k}, {i}, {float(w)!r})" for k, row in enumerate(compression.legendre(LAGS, DEGREE)) for i, w in enumerate(row))


@query(
    "m26_compressed_lags",
    f""", q AS (SELECT date AS q FROM ygrowth WHERE growth IS NOT NULL), b(power, lag, weight) AS (VALUES {_BASIS}), g AS (SELECT a.ticket, a.date, 100 * (a.value / nullif(p.value, 0) - 1) AS value FROM obs a JOIN obs p ON p.ticket = a.ticket AND p.date = a.date - INTERVAL 1 MONTH)
SELECT ticket, q AS date, CAST(power AS INTEGER) AS power, round(sum(weight * value), 5) AS value FROM q CROSS JOIN b JOIN g ON g.date = q - to_months(CAST(lag AS INTEGER)) WHERE value IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = {LAGS}""",
)
def m26(s, d):
    """Six months of each series as three polynomial sums a quarter."""
    g = panel.monthly_growth(obs(s, d)).withColumnRenamed("growth", "value")
    return rounded(compression.compressed(g, _y(s, d).filter("y is not null").select("date"), LAGS, DEGREE), "value", places=5)


@query("d13_deduped", None)
def d13(s, d):
    """Of suppliers whose quarterly growths correlate beyond 0.5, one goes; every tenth supplier is an aggregate."""
    g = _growths(s, d)[0].filter("growth is not null")
    facts = g.groupBy("ticket").agg(F.count("*").alias("length")).withColumn("aggregate", F.substring("ticket", -1, 1) == "0")
    return preparation.deduped_along(facts, g.withColumnRenamed("growth", "value"), 0.5)


@query("f05_normal_quantile", None)
def f05(s, d):
    """Critical value of each stage of multiple testing over all series, from the normal quantile."""
    p = _growths(s, d)[0].select("ticket").distinct().count()
    rows = [(k, p, NormalDist().inv_cdf(1 - 0.05 / (2 * p ** (1.0 if k == 1 else 1.5)))) for k in range(1, 6)] if p else []
    return rounded(s.createDataFrame(rows, "stage int, series long, critical double"), "critical")
