"""How well readings did: error tables, intervals, comparisons, spread and regimes.

readings: (date, vintage, spec, pred, actual), one row per reading. Nulls in pred or actual are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rms(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def table(readings: DataFrame, target: DataFrame) -> DataFrame:
    """By vintage: errors of all readings, of their median, and of no change. target: (date, growth)."""
    before = target.select("date", F.lag("growth").over(W.orderBy("date")).alias("no_change"))
    seen = readings.filter("pred is not null and actual is not null")
    e = F.col("pred") - F.col("actual")
    each = seen.groupBy("vintage").agg(rms(e).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n"))
    mid = seen.groupBy("date", "vintage").agg(F.median("pred").alias("mid"), F.max("actual").alias("actual")).join(F.broadcast(before), "date")
    mid = mid.groupBy("vintage").agg(rms(F.col("mid") - F.col("actual")).alias("rmse_median"), rms(F.col("no_change") - F.col("actual")).alias("rmse_no_change"))
    return each.join(mid, "vintage")


def interval(readings: DataFrame, errors: DataFrame) -> DataFrame:
    """Mean weighted by 1 / RMSE, its standard error 1 / sqrt(sum of weights), and the 95% interval. errors: (spec, vintage, rmse)."""
    w = errors.filter("rmse > 0").select("spec", "vintage", (1 / F.col("rmse")).alias("w"))
    x = readings.filter("pred is not null").join(w, ["spec", "vintage"]).groupBy("date", "vintage")
    x = x.agg((F.sum(F.col("pred") * F.col("w")) / F.sum("w")).alias("mean"), (1 / F.sqrt(F.sum("w"))).alias("se"))
    return x.withColumns({"low": F.col("mean") - 1.96 * F.col("se"), "high": F.col("mean") + 1.96 * F.col("se")})


def inverse_square(errors: DataFrame) -> DataFrame:
    """1 / RMSE^2, adding up to 1 within each vintage."""
    w = 1 / F.pow("rmse", F.lit(2))
    return errors.filter("rmse > 0").select("spec", "vintage", (w / F.sum(w).over(W.partitionBy("vintage"))).alias("w"))


def ranges(readings: DataFrame) -> DataFrame:
    q = [F.percentile("pred", p).alias(n) for p, n in ((0.05, "p05"), (0.95, "p95"))]
    return readings.groupBy("date").agg(F.min("pred").alias("low"), F.max("pred").alias("high"), *q)


def by_group(readings: DataFrame, group: Column) -> DataFrame:
    """Mean reading of each group beside the mean of the whole pool."""
    part = readings.groupBy("date", "vintage", group.alias("grp")).agg(F.avg("pred").alias("mean"), F.sum("pred").alias("s"), F.count("pred").alias("n"))
    pool = W.partitionBy("date", "vintage")
    return part.select("date", "vintage", "grp", "mean", (F.sum("s").over(pool) / F.sum("n").over(pool)).alias("pool_mean"))


def head_to_head(errors: DataFrame, group: Column) -> DataFrame:
    """By group: how many specifications beat the median error of their vintage, the best ratio, whose it is, the median ratio."""
    mid = errors.groupBy("vintage").agg(F.median("rmse").alias("mid"))
    x = errors.join(F.broadcast(mid), "vintage").withColumn("ratio", F.round(F.col("rmse") / F.col("mid"), 6))
    best = F.struct("ratio", "spec", "vintage")
    x = x.groupBy(group.alias("grp")).agg(F.count_if(F.col("ratio") < 1).alias("better"), F.min("ratio").alias("best"), F.min_by("spec", best).alias("best_spec"), F.median("ratio").alias("mid"))
    return x


def top(errors: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("vintage").orderBy("rmse", "spec"))
    return errors.withColumn("rank", rank).filter(F.col("rank") <= most).select("vintage", "spec", "rank")


def overlap(best: DataFrame, most: int) -> DataFrame:
    """Share of the top `most` that two vintages have in common; best holds at most that many rows a vintage."""
    x, y = best.select("spec", F.col("vintage").alias("a")), best.select("spec", F.col("vintage").alias("b"))
    return x.join(y, "spec").groupBy("a", "b").agg((F.count("*") / most).alias("share"))


def histogram(readings: DataFrame, column: str, keys: list[str], low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins; 0 holds what lies below low, bins + 1 what lies at or above high."""
    at = F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).cast("int")
    return readings.filter(F.col(column).isNotNull()).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def at_most(errors: DataFrame, middle: Column) -> DataFrame:
    """Specifications whose error is not above the given aggregate of their vintage."""
    return errors.withColumn("_m", middle.over(W.partitionBy("vintage"))).filter(F.col("rmse") <= F.col("_m")).drop("_m")


def breadth(obs: DataFrame, meta: DataFrame, grid: DataFrame, train_end: str, sigmas: float) -> DataFrame:
    """Series whose minimum over the months of a quarter that are published at a vintage lies below mean - sigmas * sd of
    their training minima. grid: (date, vintage), nine rows a quarter."""
    x = obs.join(meta.select("ticket", "months_lag"), "ticket").withColumn("quarter", F.add_months(F.trunc("date", "QUARTER"), 2))
    full = x.filter(F.col("quarter") < F.to_date(F.lit(train_end))).groupBy("ticket", "quarter").agg(F.min("value").alias("low"))
    cut = full.groupBy("ticket").agg((F.avg("low") - sigmas * F.stddev_samp("low")).alias("cut"))
    known = x.join(F.broadcast(grid.withColumnRenamed("date", "quarter")), "quarter").filter(F.add_months("date", F.col("months_lag")) <= F.add_months("quarter", F.col("vintage")))
    low = known.groupBy("ticket", "quarter", "vintage").agg(F.min("value").alias("low")).join(cut, "ticket", "left")
    return low.groupBy("quarter", "vintage").agg(F.count("*").alias("n"), F.count_if(F.col("low") < F.col("cut")).alias("broken"))


def regime(broad: DataFrame, least: int = 4, percent: int = 5) -> DataFrame:
    """A quarter is in shock from the first vintage at which at least max(least, percent of the series) are broken."""
    need = F.greatest(F.lit(least), F.ceil(F.col("n") * percent / 100))
    x = broad.withColumn("hit", (F.col("broken") >= need).cast("int"))
    on = F.max("hit").over(W.partitionBy("quarter").orderBy("vintage").rowsBetween(W.unboundedPreceding, 0)) == 1
    return x.select("quarter", "vintage", "n", "broken", on.alias("shock"))


def first_shock(regimes: DataFrame) -> DataFrame:
    return regimes.filter("shock").groupBy("quarter").agg(F.min("vintage").alias("vintage"))


def box(errors: DataFrame, column: str, keys: list[str], reach: float = 1.5) -> DataFrame:
    """Box statistics: quartiles, the lowest and highest value within `reach` quartile ranges of the box, values beyond."""
    x = errors.filter(F.col(column).isNotNull())
    q = x.groupBy(*keys).agg(*[F.percentile(column, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    low, high = F.col("q1") - reach * (F.col("q3") - F.col("q1")), F.col("q3") + reach * (F.col("q3") - F.col("q1"))
    v, inside = F.col(column), F.col(column).between(low, high)
    return x.join(q, keys).groupBy(*keys, "q1", "median", "q3").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count_if(~inside).alias("beyond"))


def scored(nowcasts: DataFrame, target: DataFrame) -> DataFrame:
    """By vintage and sample, all quarters or those behind the burn-in: errors of the nowcast, of the pool's median and of no
    change, and how many prints lie in the bands.

    nowcasts: (date, vintage, nowcast, median, actual, burn_in, lo_80, hi_80, lo_95, hi_95); target: (date, growth).
    """
    before = target.select("date", F.lag("growth").over(W.orderBy("date")).alias("_nc"))
    x = nowcasts.filter("actual is not null").join(F.broadcast(before), "date", "left")
    x = x.withColumn("sample", F.explode(F.when(F.col("burn_in"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("after")))))
    e = lambda c: F.col(c) - F.col("actual")
    hit = lambda a: F.count_if(F.col("actual").between(F.col(f"lo_{a}"), F.col(f"hi_{a}")))
    return x.groupBy("vintage", "sample").agg(
        F.count("*").alias("quarters"), rms(e("nowcast")).alias("rmse"), F.avg(F.abs(e("nowcast"))).alias("mae"), rms(e("median")).alias("rmse_median"), rms(e("_nc")).alias("rmse_no_change"), hit(80).alias("in_80"), hit(95).alias("in_95")
    )
