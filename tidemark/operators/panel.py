"""Panel building and preparation: frequency, growth, fills, deflation, data-quality rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import month, month_calendar, months_between, quarter_stamp
from tidemark.sources.files import written


def by_ticket():
    return W.partitionBy("ticket").orderBy("date")


def before():
    return by_ticket().rowsBetween(W.unboundedPreceding, 0)


def after():
    return by_ticket().rowsBetween(0, W.unboundedFollowing)


def whole():
    return W.partitionBy("ticket")


def growth(now: Column, earlier: Column) -> Column:
    return 100 * (now / F.nullif(earlier, F.lit(0)) - 1)


def to_month(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Last non-null, mean and sum of each month."""
    seen = daily.filter("value is not null")
    return seen.groupBy(*keys, month("date").alias("month")).agg(F.max_by("value", "date").alias("last"), F.avg("value").alias("mean"), F.sum("value").alias("total"))


def to_quarter(obs: DataFrame, meta: DataFrame) -> DataFrame:
    """Quarterly value by each series' own method: mean, last or sum."""
    x = obs.join(meta.select("ticket", "agg_method"), "ticket").groupBy("ticket", quarter_stamp("date").alias("date"), "agg_method")
    x = x.agg(F.avg("value").alias("mean"), F.max_by("value", "date").alias("last"), F.sum("value").alias("total"))
    return x.select("ticket", "date", F.when(F.col("agg_method") == "mean", F.col("mean")).when(F.col("agg_method") == "last", F.col("last")).otherwise(F.col("total")).alias("value"))


def quarterly_growth(q: DataFrame) -> DataFrame:
    """Change between consecutive observed values."""
    return q.select("ticket", "date", growth(F.col("value"), F.lag("value").over(by_ticket())).alias("growth"))


def monthly_growth(obs: DataFrame, back: int = 1) -> DataFrame:
    """Null unless both months were observed."""
    earlier = obs.select("ticket", F.add_months("date", back).alias("date"), F.col("value").alias("before"))
    return obs.join(earlier, ["ticket", "date"], "left").select("ticket", "date", growth(F.col("value"), F.col("before")).alias("growth"))


def infer_frequency(obs: DataFrame) -> DataFrame:
    """From the median gap in days between observations."""
    gap = obs.withColumn("gap", F.datediff("date", F.lag("date").over(by_ticket()))).groupBy("ticket").agg(F.median("gap").alias("gap"))
    g = F.col("gap")
    kind = F.when(g <= 2, "daily").when(g.between(25, 35), "monthly").when(g.between(80, 100), "quarterly").when(g.between(320, 430), "yearly").otherwise("unknown")
    return gap.select("ticket", "gap", kind.alias("freq"))


def profile(obs: DataFrame) -> DataFrame:
    return obs.groupBy("ticket").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("value").alias("obs"))


def inferred_lag(obs: DataFrame, as_of: str) -> DataFrame:
    last = obs.groupBy("ticket").agg(F.max("date").alias("last"))
    return last.select("ticket", F.greatest(months_between(F.to_date(F.lit(as_of)), F.col("last")), F.lit(0)).alias("months_lag"))


def on_calendar(obs: DataFrame) -> DataFrame:
    return month_calendar(obs, ["ticket"]).join(obs, ["ticket", "date"], "left")


def filled(obs: DataFrame) -> DataFrame:
    """Forward, then backward fill on the full calendar."""
    x = on_calendar(obs)
    return x.select("ticket", "date", F.coalesce(F.last("value", True).over(before()), F.first("value", True).over(after())).alias("value"))


def interpolated(obs: DataFrame) -> DataFrame:
    """Straight lines across interior gaps."""
    x = on_calendar(obs)
    at = F.when(F.col("value").isNotNull(), F.col("date"))
    x = x.select("ticket", "date", "value", F.last("value", True).over(before()).alias("v0"), F.first("value", True).over(after()).alias("v1"), F.last(at, True).over(before()).alias("d0"), F.first(at, True).over(after()).alias("d1"))
    share = months_between(F.col("date"), F.col("d0")) / months_between(F.col("d1"), F.col("d0"))
    return x.select("ticket", "date", F.coalesce("value", F.col("v0") + (F.col("v1") - F.col("v0")) * share).alias("value"))


def mean_filled(obs: DataFrame, train_end: str) -> DataFrame:
    """Gaps take the mean over the training months."""
    x = on_calendar(obs)
    mean = F.avg(F.when(F.col("date") < F.to_date(F.lit(train_end)), F.col("value"))).over(whole())
    return x.select("ticket", "date", F.coalesce("value", mean).alias("value"))


def exact_percentile(df: DataFrame, column: str, share: float, most: int = 1_000_000) -> float | None:
    """The percentile between its two neighbours in order, nulls skipped; null without values.

    Approximate percentiles, whose states are bounded, narrow the values down to a range that holds both neighbours, again
    until the range has at most `most` rows or one value; those few are then taken exactly.
    """
    x = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    rows = x.count()
    if not rows:
        return None
    place, below = (rows - 1) * share, 0
    while rows > most:
        at, slack = (place - below) / rows, max(0.001, 2 / rows)
        low, high = x.agg(F.percentile_approx("v", [max(at - slack, 0.0), min(at + slack, 1.0)], 10_000)).first()[0]
        if low == high:
            return low
        inside = x.filter(F.col("v").between(low, high))
        under, held = x.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if held == rows:
            break
        x, below, rows = inside, below + under, held
    return x.agg(F.percentile("v", min(max((place - below) / max(rows - 1, 1), 0.0), 1.0))).first()[0]


def capped(daily: DataFrame, share: float = 0.9) -> DataFrame:
    """Values above the percentile become the mean of those below it."""
    x = daily.withColumn("cut", F.lit(exact_percentile(daily, "value", share)).cast("double"))
    low = x.filter("value <= cut").agg(F.avg("value").alias("low"))
    return x.crossJoin(F.broadcast(low)).withColumn("value", F.when(F.col("value") > F.col("cut"), F.col("low")).otherwise(F.col("value"))).drop("cut", "low")


def to_months(obs: DataFrame, kinds: DataFrame, yearly: str = "jan") -> DataFrame:
    """Observations of any frequency at month starts: of a month, quarter or year the last one counts. Quarters are stamped
    at their last month; a year at its January, or with yearly="ffill" or "mean" at all its months.

    kinds: (ticket, frequency), frequency `daily`, `monthly`, `quarterly` or `yearly`; any other, or none, as monthly.
    """
    if yearly not in ("jan", "ffill", "mean"):
        raise ValueError("yearly must be jan, ffill or mean")
    unit = F.when(F.col("frequency") == "quarterly", "QUARTER").when(F.col("frequency") == "yearly", "YEAR").otherwise("MONTH")
    # as many parts as the session has, for rows this short fill few parts by bytes and then large tables in each
    seen = obs.filter("value is not null").repartition(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticket")
    x = seen.join(kinds.select("ticket", "frequency"), "ticket", "left").withColumn("_u", unit)
    at = F.when(F.col("_u") == "QUARTER", F.add_months(F.trunc("date", "QUARTER"), 2)).when(F.col("_u") == "YEAR", F.trunc("date", "YEAR")).otherwise(F.trunc("date", "MONTH"))
    x = x.groupBy("ticket", "_u", at.alias("_at")).agg(F.max_by("value", "date").alias("value"))
    spread = F.when(F.col("_u") == "YEAR", F.sequence("_at", F.add_months("_at", 11), F.expr("interval 1 month"))).otherwise(F.array("_at"))
    date = F.col("_at") if yearly == "jan" else F.explode(spread)
    return x.select("ticket", date.alias("date"), "value")


def deflated(obs: DataFrame, meta: DataFrame, index: DataFrame, base_year: int) -> DataFrame:
    """Nominal series over the price index, times its mean in the base year."""
    base = index.filter(F.year("date") == base_year).agg(F.avg("price").alias("base"))
    x = obs.join(meta.select("ticket", "nominal"), "ticket").join(index, "date", "left").crossJoin(F.broadcast(base))
    return x.select("ticket", "date", F.when(F.col("nominal") == 1, F.col("value") / F.col("price") * F.col("base")).otherwise(F.col("value")).alias("value"))


def usable(obs: DataFrame, least: int = 24, last: int = 36, distinct: int = 10) -> DataFrame:
    """Too few observations, or degenerate: constant over the latest ones or with few distinct values."""
    x = obs.filter("value is not null").withColumn("r", F.row_number().over(W.partitionBy("ticket").orderBy(F.desc("date"))))
    x = x.groupBy("ticket").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"), F.count_distinct(F.when(F.col("r") <= last, F.col("value"))).alias("recent"))
    return x.select("ticket", "n", (F.col("n") < least).alias("short"), ((F.col("recent") <= 1) | (F.col("values") < distinct)).alias("degenerate"))


def extremes(obs: DataFrame, train_end: str) -> DataFrame:
    """Largest |z| against training moments, and where."""
    train = F.when(F.col("date") < F.to_date(F.lit(train_end)), F.col("value"))
    z = (F.col("value") - F.avg(train).over(whole())) / F.nullif(F.stddev_samp(train).over(whole()), F.lit(0.0))
    x = obs.withColumn("z", F.round(F.abs(z), 8)).filter("z is not null")
    return x.groupBy("ticket").agg(F.max("z").alias("z"), F.max_by("date", F.struct("z", "date")).alias("date"))


def quarter_range(obs: DataFrame) -> DataFrame:
    return obs.groupBy("ticket", quarter_stamp("date").alias("date")).agg(F.min("value").alias("low"), F.max("value").alias("high"), (F.max("value") - F.min("value")).alias("range"))


def shock_quarters(obs: DataFrame, train_end: str, sigmas: float = 3.0) -> DataFrame:
    """Quarters in which at least max(4, 5% of the series) have a minimum below mean - 3 sd of their training minima.

    A minimum that equals that bound is not below it: what is within rounding (1e-13 of the bound's terms) counts as equal, so
    that the order of summation decides nothing.
    """
    q = quarter_range(obs)
    train = F.when(F.col("date") < F.to_date(F.lit(train_end)), F.col("low"))
    mean, off = F.avg(train).over(whole()), sigmas * F.stddev_samp(train).over(whole())
    q = q.withColumn("broken", (F.col("low") < mean - off - 1e-13 * (F.abs(mean) + off)).cast("int"))
    q = q.groupBy("date").agg(F.count("*").alias("n"), F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"))
    return q.select("date", "n", "broken", (F.col("broken") >= F.greatest(F.lit(4), F.ceil(F.col("n") * 5 / 100))).alias("shock"))


def flattened(q_months: DataFrame, months: int = 3) -> DataFrame:
    """One row per quarter stamp: the month and the months before it as columns."""
    x = on_calendar(q_months)
    lags = [F.lag("value", k).over(by_ticket()).alias(f"m{k}") for k in range(1, months)]
    return x.select("ticket", "date", F.col("value").alias("m0"), *lags).filter(F.month("date") % 3 == 0)


def rolling_last(daily: DataFrame, rows: int = 30) -> DataFrame:
    """Mean of the last rows (not days) by sector, then the month's last."""
    day = daily.groupBy("sector", "date").agg(F.avg("value").alias("value"))
    roll = day.withColumn("value", F.avg("value").over(W.partitionBy("sector").orderBy("date").rowsBetween(-(rows - 1), 0)))
    return roll.groupBy("sector", month("date").alias("month")).agg(F.max_by("value", "date").alias("value"))


def pair_correlations(series: DataFrame, block: int = 8192, least: float | None = None) -> DataFrame:
    """(a, b, n, r) of every pair of tickets a < b with common dates: their number and the correlation on them, null
    where either does not vary there. series: (ticket, date, value), values not null. With `least`, only pairs whose |r|
    is at least that.

    Tickets are dealt by hash into blocks of about `block`, or less where tickets are few; each pair of blocks is one task's
    work, so that any two tickets meet once. A series is sent as one row to each pair of its block, so what is sent grows
    with the series times the blocks; blocks are large for that, and a task hands its pairs on 128 series at a time. Pairs
    are numbered by the series, whose square no run escapes.
    """
    x = series.groupBy("ticket").agg(F.array_sort(F.collect_list(F.struct("date", F.col("value").cast("double").alias("value")))).alias("v"))
    x = written(x.select("ticket", F.col("v.date").alias("date"), F.col("v.value").alias("value")))
    n = x.count()
    blocks = max(1, -(-n // block), min(16, -(-n // 64)))
    x = x.select("ticket", "date", "value", F.pmod(F.xxhash64("ticket"), F.lit(blocks)).cast("int").alias("block"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = x.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "ticket", "date", "value")
    met = met.repartition(min(blocks * (blocks + 1) // 2, 2000), "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _block_correlations(pa.Table.from_batches(list(batches)), least)

    return met.groupBy("i", "j").applyInArrow(run, "a string, b string, n long, r double")


def _block_correlations(t: pa.Table, least: float | None) -> Iterator[pa.RecordBatch]:
    t = t.combine_chunks()
    names = np.asarray(t.column("ticket").to_pylist(), object)
    order = np.argsort(names)
    names, block = pa.array(names[order], pa.string()), t.column("block").to_numpy()[order]
    value, there = on_dates(t.take(pa.array(order)))
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for k, n, r in correlated(value, there, left, right, i == j):
        keep = n > 0
        if least is not None:
            keep &= np.abs(r) >= least
        u, v = np.nonzero(keep)
        a, b, near = np.minimum(k[u], right[v]), np.maximum(k[u], right[v]), r[u, v]
        yield pa.RecordBatch.from_pydict({"a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "n": pa.array(n[u, v].astype(np.int64)), "r": pa.array(near, mask=np.isnan(near))})


def on_dates(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Values and where there are some, series by the dates of all of them; t has arrays `date` and `value`, one row a series."""
    t = t.combine_chunks()
    row = np.repeat(np.arange(t.num_rows), [len(d) for d in t.column("date")])
    dates, col = np.unique(t.column("date").combine_chunks().flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    value, there = np.zeros((t.num_rows, len(dates))), np.zeros((t.num_rows, len(dates)), bool)
    value[row, col], there[row, col] = t.column("value").combine_chunks().flatten().to_numpy(), True
    return value, there


def correlated(value: np.ndarray, there: np.ndarray, left: np.ndarray, right: np.ndarray, once: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By up to 128 rows k of `left`: k, and against all rows of `right` the number of common dates and the correlation on
    them, nan where either does not vary. With `once`, pairs whose left row is not the smaller one have no common dates."""
    # sums are of differences from each series' mean; series with values that are no finite numbers go the long way
    plain = np.isfinite(value).all(1)
    seen = there.astype(float)
    x = np.where(plain[:, None], value, 0.0)
    x = np.where(there, x - (x.sum(1) / np.maximum(seen.sum(1), 1))[:, None], 0.0)
    with np.errstate(all="ignore"):
        squares = x * x
        for s in range(0, len(left), 128):
            k = left[s : s + 128]
            n, sx, sy = seen[k] @ seen[right].T, x[k] @ seen[right].T, seen[k] @ x[right].T
            xx, yy = squares[k] @ seen[right].T, seen[k] @ squares[right].T
            vx, vy = xx - sx * sx / n, yy - sy * sy / n
            r = (x[k] @ x[right].T - sx * sy / n) / np.sqrt(vx * vy)
            if once:
                n = np.where(k[:, None] < right, n, 0)
            # where little is left of the squares, r would lose digits
            far = ~((vx > 1e-5 * xx) & (vy > 1e-5 * yy)) | ~plain[k][:, None] | ~plain[right]
            long = np.argwhere((n > 0) & far)
            for at in range(0, len(long), 20_000):
                u, v = long[at : at + 20_000].T
                r[u, v] = _pairwise(value, there, k[u], right[v])
            yield k, n, r


def _pairwise(value: np.ndarray, there: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlations of rows a and b on their common columns, nan where either does not vary there."""
    both, dev, flat = there[a] & there[b], [], np.zeros(len(a), bool)
    for v in (value[a], value[b]):
        flat |= np.where(both, v, np.inf).min(1) == np.where(both, v, -np.inf).max(1)
        dev.append(np.where(both, v - (np.where(both, v, 0).sum(1) / both.sum(1))[:, None], 0))
    r = (dev[0] * dev[1]).sum(1) / np.sqrt((dev[0] ** 2).sum(1) * (dev[1] ** 2).sum(1))
    return np.where(flat, np.nan, r)
