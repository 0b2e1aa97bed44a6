"""Classical additive seasonal adjustment, by windows and regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def adjusted(obs: DataFrame, period: int = 12) -> DataFrame:
    """(ticket, date, value, trend, seasonal, adjusted) of series with at least two periods of observed values.

    Trend: centred average of a period (of period + 1 values with half weights at the ends, as period is even); before the
    first and after the last one it is the line through the nearest `period` trend values. Seasonal: mean of what is left
    at each position of the period, less the mean of these means. Gaps are dropped, not filled.
    """
    half, by = period // 2, W.partitionBy("ticket").orderBy("date")
    x = obs.filter("value is not null").withColumn("i", F.row_number().over(by)).withColumn("n", F.count("*").over(W.partitionBy("ticket")))
    x = x.filter(F.col("n") >= 2 * period)
    ends = F.lag("value", half).over(by) + F.lead("value", half).over(by)
    x = x.withColumn("t", (F.sum("value").over(by.rowsBetween(-half, half)) - ends / 2) / period)
    first, last = F.col("i") <= half + period, F.col("i") > F.col("n") - half - period
    line = lambda f, part, name: f(F.when(part, F.col("t")), F.when(part, F.col("i"))).alias(name)
    ends = x.groupBy("ticket").agg(line(F.regr_slope, first, "b0"), line(F.regr_intercept, first, "a0"), line(F.regr_slope, last, "b1"), line(F.regr_intercept, last, "a1"))
    x = x.join(ends, "ticket").withColumn("trend", F.coalesce("t", F.when(F.col("i") <= half, F.col("a0") + F.col("b0") * F.col("i")).otherwise(F.col("a1") + F.col("b1") * F.col("i"))))
    x = x.withColumn("k", F.pmod(F.col("i") - 1, F.lit(period)))
    means = x.groupBy("ticket", "k").agg(F.avg(F.col("value") - F.col("trend")).alias("m"))
    means = means.withColumn("seasonal", F.col("m") - F.avg("m").over(W.partitionBy("ticket")))
    return x.join(means, ["ticket", "k"]).select("ticket", "date", "value", "trend", "seasonal", (F.col("value") - F.col("seasonal")).alias("adjusted"))
