"""Queries on text, admission rules, fills and small fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import texts
from tidemark.operators import panel, pool, preparation, vintage
from tidemark.plans.pool_queries import WEIGHTS, readings
from tidemark.plans.queries import CAL, SPLIT, TEST, _growths, query, rounded
from tidemark.testbed import meta, obs, read, target


@query(
    "p03_numbers",
    """ SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_totalprice WHEN 1 THEN -o_totalprice WHEN 2 THEN 0.0 WHEN 3 THEN NULL ELSE floor(o_totalprice) END AS value FROM orders""",
)
def p03(s, d):
    """Amounts written as a statistics office would, and read again (P03, P04)."""
    k, v = F.col("o_orderkey") % 5, F.col("o_totalprice")
    text = F.when(k == 0, F.format_number(v, 2)).when(k == 1, F.concat(F.lit("("), F.format_number(v, 2), F.lit(")"))).when(k == 2, "<1").when(k == 3, "n.d.").otherwise(F.concat(F.lit(" "), F.format_number(F.floor(v), 0), F.lit("\n")))
    return read(s, d, "orders").select("o_orderkey", texts.number(text).alias("value"))


@query("p05_dates", " SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 2 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 6 < 4 THEN CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE) ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS date FROM orders")
def p05(s, d):
    """Dates written in six ways and read again."""
    k, t = F.col("o_orderkey") % 6, F.col("o_orderdate")
    year, quarter = F.year(t).cast("string"), F.quarter(t).cast("string")
    text = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "dd/MM/yyyy")).when(k == 2, F.concat(year, F.lit("-Q"), quarter))
    text = text.when(k == 3, F.concat(F.lit("Q"), quarter, F.lit(" "), year)).when(k == 4, F.date_format(t, "yyyyMM")).otherwise(F.date_format(t, "MMM-yy"))
    text = F.when((k == 5) & (F.year(t) < 2000), F.date_format(t, "yyyyMM")).otherwise(text)  # two-digit years are read as 20YY
    return read(s, d, "orders").select("o_orderkey", texts.date(text).alias("date"))


@query("p17_catalogue", " SELECT p_partkey, p_name, v AS vintage, CAST(greatest(least(3 - (p_size % 9 - v), 3), 0) AS INTEGER) AS months FROM part, unnest(range(-2, 7)) AS t(v) WHERE lower(p_name) LIKE '%ring%'")
def p17(s, d):
    """Catalogue entries that hold a word, with the months known of a quarter at every vintage."""
    hit = read(s, d, "part").filter(F.lower("p_name").contains("ring")).withColumn("vintage", F.explode(F.array(*[F.lit(v).cast("long") for v in vintage.VINTAGES])))
    return hit.select("p_partkey", "p_name", "vintage", F.greatest(F.least(3 - (F.col("p_size") % 9 - F.col("vintage")), F.lit(3)), F.lit(0)).cast("int").alias("months"))


@query("p18_spec_names", " SELECT DISTINCT p_brand AS spec, regexp_extract(p_brand, '^([A-Za-z]+)#?([0-9]+)(.*)$', 1) AS method, CAST(regexp_extract(p_brand, '^([A-Za-z]+)#?([0-9]+)(.*)$', 2) AS INTEGER) AS k, '' AS variant FROM part WHERE regexp_matches(p_brand, '#1')")
def p18(s, d):
    """Specifications whose name matches, in their parts (P18, P22)."""
    return read(s, d, "part").select(F.col("p_brand").alias("spec")).filter(F.col("spec").rlike("#1")).distinct().select("spec", *texts.spec_parts(F.col("spec")))


@query("p21_vintage_names", " SELECT DISTINCT date, v AS vintage, CASE WHEN v < 0 THEN 'p' || v ELSE 'p+' || v END AS name FROM target, unnest(range(-2, 7)) AS t(v)")
def p21(s, d):
    return vintage.grid(target(s, d)).select("date", F.col("vintage").cast("long").alias("vintage"), texts.vintage_name(F.col("vintage")).alias("name"))


@query("p23_split", f" SELECT ticket, date, value, CASE WHEN date < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS sample FROM obs")
def p23(s, d):
    return obs(s, d).withColumn("sample", F.when(F.col("date") < F.to_date(F.lit(SPLIT)), "train").otherwise("test"))


@query("a03_to_year", " SELECT ticket, CAST(year(date) AS INTEGER) AS year, round(avg(value), 6) AS mean, arg_min(value, date) AS first FROM obs GROUP BY 1, 2")
def a03(s, d):
    """Yearly values: the mean, and the first observation."""
    return rounded(obs(s, d).groupBy("ticket", F.year("date").alias("year")).agg(F.avg("value").alias("mean"), F.min_by("value", "date").alias("first")), "mean")


_TWICE = ", both_obs AS (SELECT ticket, date, value FROM obs UNION ALL SELECT ticket || 'D', date, value * (1 + 1e-8) FROM obs JOIN meta USING (ticket) WHERE agg_method = 'last')"


@query("d03_duplicates", _TWICE + ", p AS (SELECT a.ticket AS kept, b.ticket, count(*) AS n, max(abs(a.value - b.value) - (1e-9 + 1e-6 * abs(b.value))) AS off FROM both_obs a JOIN both_obs b ON a.date = b.date AND a.ticket < b.ticket GROUP BY 1, 2) SELECT ticket, min(kept) AS copy_of FROM p WHERE n >= 24 AND off <= 0 GROUP BY 1")
def d03(s, d):
    """A third of the series comes twice, with a difference within tolerance."""
    o = obs(s, d)
    again = o.join(meta(s, d).filter("agg_method = 'last'"), "ticket", "left_semi").select(F.concat("ticket", F.lit("D")).alias("ticket"), "date", (F.col("value") * (1 + 1e-8)).alias("value"))
    return preparation.duplicates(o.unionByName(again))


@query("d05_history", f", h AS (SELECT ticket, count(*) FILTER (WHERE date >= DATE '1996-01-01' AND date < DATE '{TEST}' AND value IS NOT NULL) AS seen FROM obs GROUP BY 1) SELECT ticket, seen, round(1 - seen / 59.0, 6) AS missing, 1 - seen / 59.0 <= 0.75 AND seen >= 24 AS stays FROM h")
def d05(s, d):
    return rounded(preparation.history(obs(s, d), "1996-01-01", TEST), "missing")


@query("d06_stale", " SELECT ticket, max(date) AS last FROM obs GROUP BY 1 HAVING max(date) < DATE '2001-12-01'")
def d06(s, d):
    return obs(s, d).groupBy("ticket").agg(F.max("date").alias("last")).filter(F.col("last") < F.to_date(F.lit("2001-12-01")))


@query("d14_thin", CAL + " SELECT ticket, round(avg(CASE WHEN value > 180 THEN 1.0 ELSE 0.0 END), 6) AS share FROM full_obs GROUP BY 1 HAVING avg(CASE WHEN value > 180 THEN 1.0 ELSE 0.0 END) < 0.45")
def d14(s, d):
    """Series with few months of sales beyond 180."""
    return rounded(preparation.thin(obs(s, d).withColumn("value", F.col("value") - 180), 0.45), "share")


@query("d19_winsorised", f", b AS (SELECT ticket, avg(value) AS m, 1.5 * stddev_samp(value) AS s FROM obs WHERE date < DATE '{SPLIT}' GROUP BY 1) SELECT ticket, date, round(CASE WHEN s IS NULL THEN value ELSE greatest(least(value, m + s), m - s) END, 5) AS value FROM obs LEFT JOIN b USING (ticket)")
def d19(s, d):
    return rounded(preparation.winsorised(obs(s, d), SPLIT, 1.5), "value", places=5)


@query("d21_one_source", " , q AS (SELECT ticket, date, CASE WHEN month(date) % 2 = 0 THEN value END AS value, 1 AS source FROM obs UNION ALL SELECT ticket, date, -value, 2 FROM obs) SELECT ticket, date, arg_min(value, source) FILTER (WHERE value IS NOT NULL) AS value FROM q GROUP BY 1, 2")
def d21(s, d):
    """A second source fills what the first leaves null (A31, D21)."""
    o = obs(s, d)
    first = o.select("ticket", "date", F.when(F.month("date") % 2 == 0, F.col("value")).alias("value"), F.lit(1).alias("source"))
    return preparation.one_source(first.unionByName(o.select("ticket", "date", (-F.col("value")).alias("value"), F.lit(2).alias("source"))))


@query("w12_effective_lags", ", g AS (SELECT CAST(v AS INTEGER) AS vintage, CAST(l AS INTEGER) AS l, greatest(1, CAST(ceil(greatest(0, 5 - v) / 3.0) AS INTEGER)) + l - 1 AS k FROM unnest(range(-2, 7)) AS t(v), unnest(range(1, 3)) AS u(l)), n AS (SELECT date, y, row_number() OVER (ORDER BY date) AS r FROM target), j AS (SELECT a.date, vintage, l, b.y FROM n a CROSS JOIN g LEFT JOIN n b ON b.r = a.r - k) SELECT date, vintage, l, round(coalesce(y, avg(y) OVER (PARTITION BY vintage, l)), 6) AS y FROM j")
def w12(s, d):
    return rounded(preparation.effective_lags(target(s, d), vintage.VINTAGES, 5), "y")


@query("w15_first_quarter", " SELECT ticket, min(date) AS first FROM qgrowth WHERE growth IS NOT NULL GROUP BY 1")
def w15(s, d):
    return panel.quarterly_growth(panel.to_quarter(obs(s, d), meta(s, d))).filter("growth is not null").groupBy("ticket").agg(F.min("date").alias("first"))


@query("w19_spread_pick", ", s AS (SELECT p_size AS k, round(avg(p_retailprice), 6) AS score FROM part GROUP BY 1), b AS (SELECT *, CAST(floor((k - 1) / 10.0) AS INTEGER) AS bin FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY score, k) = 1 AS own_bin FROM b) SELECT k, score, own_bin FROM f ORDER BY own_bin DESC, score, k LIMIT 5")
def w19(s, d):
    x = read(s, d, "part").groupBy(F.col("p_size").alias("k")).agg(F.round(F.avg("p_retailprice"), 6).alias("score"))
    return preparation.spread_pick(x, 1, 51, 5)


@query("w22_inside_filled", CAL + " SELECT ticket, date, round(coalesce(value, avg(value) OVER (PARTITION BY ticket)), 6) AS value FROM full_obs")
def w22(s, d):
    return rounded(preparation.inside_filled(obs(s, d)), "value")


@query("w25_windows", f" SELECT t.date AS test, q.date FROM target t JOIN target q ON q.date + INTERVAL 3 MONTH <= t.date WHERE t.date >= DATE '{TEST}'")
def w25(s, d):
    return preparation.training_windows(target(s, d), TEST)


@query("j09_as_of", ", q AS (SELECT date, y FROM target WHERE month(date) = 6) SELECT o.ticket, o.date, coalesce((SELECT max_by(y, q.date) FROM q WHERE q.date <= o.date), (SELECT min_by(y, q.date) FROM q)) AS y FROM obs o")
def j09(s, d):
    """Latest yearly print at or before each month; the earliest where there is none. Looked up once for every date."""
    o = obs(s, d).select("ticket", "date")
    return o.join(F.broadcast(vintage.as_of(o.select("date").distinct(), target(s, d).filter(F.month("date") == 6), "date", "y")), "date").select("ticket", "date", "y")


@query(
    "j10_chain",
    WEIGHTS + """, n AS (SELECT date, vintage, round(sum(pred * w) / sum(w), 5) AS nowcast FROM weighted GROUP BY 1, 2), k AS (SELECT * FROM n WHERE vintage % 3 = 0), g AS (SELECT DISTINCT date, vintage FROM n)
SELECT g.date, g.vintage, max_by(k.nowcast, k.vintage) AS nowcast, max(k.vintage) AS read_at FROM g LEFT JOIN k ON k.date = g.date AND k.vintage <= g.vintage GROUP BY 1, 2""",
)
def j10(s, d):
    n = rounded(pool.combined(pool.weights(readings(s, d), 2)), "nowcast", places=5)
    return preparation.chain(n.filter("vintage % 3 = 0"), n.select("date", "vintage"))


@query("m14_lines", ", j AS (SELECT ticket, q.growth AS x, y.growth AS y FROM qgrowth q JOIN ygrowth y USING (date) WHERE q.growth IS NOT NULL AND y.growth IS NOT NULL) SELECT ticket, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM j GROUP BY 1")
def m14(s, d):
    return rounded(preparation.fitted_lines(*_growths(s, d)), "slope", "intercept", "r2")


@query("r06_corrected", " SELECT ticket, date, CASE WHEN date >= DATE '2001-01-01' THEN value + 1 ELSE value END AS value FROM obs")
def r06(s, d):
    """A later release replaces the published values of its months."""
    o = obs(s, d)
    return preparation.corrected(o, o.filter("date >= DATE '2001-01-01'").withColumn("value", F.col("value") + 1))
