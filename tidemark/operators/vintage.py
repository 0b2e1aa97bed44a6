"""What was known when: publication lags, as-of joins, target lags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import months_between

VINTAGES = range(-2, 7)


def grid(quarters: DataFrame) -> DataFrame:
    """Every quarter at every vintage; nine rows a quarter."""
    return quarters.select("date").distinct().withColumn("vintage", F.explode(F.array(*map(F.lit, VINTAGES))))


def blanked(obs: DataFrame, meta: DataFrame, test: str, vintage: int) -> DataFrame:
    """Null the last max(0, lag - vintage) months up to the test month."""
    gone = F.greatest(F.col("months_lag") - vintage, F.lit(0))
    ahead = months_between(F.to_date(F.lit(test)), F.col("date"))
    x = obs.filter(F.col("date") <= F.to_date(F.lit(test))).join(meta.select("ticket", "months_lag"), "ticket")
    return x.select("ticket", "date", F.when(ahead >= gone, F.col("value")).alias("value"))


def aligned(obs: DataFrame, meta: DataFrame, vintage: int) -> DataFrame:
    """Shift each series by max(0, lag - vintage) months."""
    by = F.greatest(F.col("months_lag") - vintage, F.lit(0))
    return obs.join(meta.select("ticket", "months_lag"), "ticket").select("ticket", F.add_months("date", by).alias("date"), "value")


def months_observed(obs: DataFrame, meta: DataFrame, quarters: DataFrame) -> DataFrame:
    """Months of each quarter that were published by each vintage. Joined on the quarter first."""
    x = obs.join(meta.select("ticket", "months_lag"), "ticket").withColumn("quarter", F.add_months(F.trunc("date", "QUARTER"), 2))
    g = grid(quarters).withColumnRenamed("date", "quarter")
    known = x.join(F.broadcast(g), "quarter").filter(F.add_months("date", F.col("months_lag")) <= F.add_months("quarter", F.col("vintage")))
    return known.groupBy("ticket", "quarter", "vintage").agg(F.count("value").alias("months"))


def as_of(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Latest right row at or before each left date; the earliest one if there is none.

    Only dates meet in one task, as many as the calendar has; left rows then find their date's value by a join.
    """
    known = right.groupBy(F.col(key).cast("date").alias("_d")).agg(F.max(value).alias("_v"))
    days = left.select(F.col("date").alias("_d")).distinct().join(known, "_d", "full")
    by = W.orderBy("_d")
    then, first = F.last("_v", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)), F.first("_v", ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing))
    at = days.select(F.col("_d").alias("date"), F.coalesce(then, first).alias(value))
    return left.join(at, "date", "left").select(*left.columns, value)


def target_lags(target: DataFrame, lag_months: int, lags: int = 2) -> DataFrame:
    """The l-th most recent quarter that was printed at each (quarter, vintage), by value."""
    printed = target.select(F.col("date").alias("q"), "y")
    g = F.broadcast(grid(target))
    j = printed.join(g, (F.add_months("q", lag_months) <= F.add_months("date", F.col("vintage"))) & (F.col("q") < F.col("date")))
    j = j.withColumn("l", F.row_number().over(W.partitionBy("date", "vintage").orderBy(F.desc("q")))).filter(F.col("l") <= lags)
    return j.select("date", "vintage", "l", "y")


def chained_lags(nowcasts: DataFrame, target: DataFrame, lag_months: int, lags: int = 2) -> DataFrame:
    """(date, vintage, l, y): the target l quarters before each (quarter, vintage): its print if published by then, else its
    own latest nowcast made by then, else the latest print before it. nowcasts: (date, vintage, nowcast)."""
    g = grid(target).withColumn("l", F.explode(F.array(*map(F.lit, range(1, lags + 1))))).withColumn("q", F.add_months("date", -3 * F.col("l")))
    key = ["date", "vintage", "l"]
    n = nowcasts.filter("nowcast is not null").select(F.col("date").alias("q"), F.col("vintage").alias("_at"), "nowcast")
    own = g.join(n, "q").filter(F.col("_at") <= F.col("vintage") + 3 * F.col("l")).groupBy(*key).agg(F.max_by("nowcast", "_at").alias("own"))
    p = target.filter("y is not null").select(F.col("date").alias("p"), "y")  # one row a quarter
    seen = g.join(F.broadcast(p), (F.col("p") <= F.col("q")) & (F.add_months("p", lag_months) <= F.add_months("date", F.col("vintage"))))
    seen = seen.groupBy(*key).agg(F.max_by("y", "p").alias("recent"), F.max("p").alias("recent_date"))
    x = g.join(own, key, "left").join(seen, key, "left")
    return x.select(*key, F.coalesce(F.when(F.col("recent_date") == F.col("q"), F.col("recent")), "own", "recent").alias("y"))


def folds(quarters: DataFrame, first: int = 16, step: int = 2, ahead: int = 4) -> DataFrame:
    """Expanding-window folds: (fold, quarter, part), part train or test."""
    q = quarters.select("date").distinct().withColumn("i", F.row_number().over(W.orderBy("date")) - 1)
    n = q.agg(F.count("*").alias("n"))
    f = n.filter(F.col("n") > first + ahead).select(F.explode(F.sequence(F.lit(first), F.col("n") - ahead - 1, F.lit(step))).alias("fold"))
    j = q.join(F.broadcast(f), F.col("i") < F.col("fold") + ahead)
    return j.select(F.col("fold").cast("long"), "date", F.when(F.col("i") < F.col("fold"), "train").otherwise("test").alias("part"))


def screened(growth: DataFrame, target: DataFrame, as_of_date: str, least: int = 8) -> DataFrame:
    """Series by absolute correlation with the target on quarters before the date; pairs with nulls drop out.

    Ranked within thousandths of the score, to which the numbers of series in better thousandths are added.
    """
    j = growth.join(F.broadcast(target.withColumnRenamed("growth", "y")), "date").filter(F.col("date") < F.to_date(F.lit(as_of_date))).filter("growth is not null and y is not null")
    s = j.groupBy("ticket").agg(F.corr("growth", "y").alias("r"), F.count("*").alias("n")).filter((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    s = s.withColumn("score", F.round(F.abs("r"), 8)).withColumn("bucket", F.floor(F.col("score") * 1000).cast("int"))
    ahead = F.coalesce(F.sum("n").over(W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = s.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", ahead.alias("ahead"))
    inside = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("score"), "ticket"))
    return s.join(F.broadcast(places), "bucket").select("ticket", "score", (inside + F.col("ahead")).cast("int").alias("rank"))
