"""Fitted cells: lines fitted for each (specification, test quarter), read at every vintage with what was published by then.

The panel is monthly, (ticket, date, value), the target quarterly, (date, y), at the quarter's last month. A specification
is a set of tickets, each with its month and the months before it (`flat` of them), or `factors` principal components of
them, and `lags` of the target. Every estimator here gives a line in the tickets' months, so a fitted cell is rows of a
coefficient table, (spec, date, estimator, ticket, lag, beta), and a reading is a join of that table with the panel: at
vintage v a ticket with publication lag p is known up to max(0, p - v) months before the quarter's end, and stays at its
last known value from there.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import months_between
from tidemark.operators import vintage
from tidemark.operators.estimators import LINES, Estimator, standardised
from tidemark.sources.files import written

#: Tickets that stand for the constant and for the target's own quarters.
CONSTANT, OWN = "1", "y"
DECAY, SEEN, QUARTERS = 0.95, 23, 8
EPOCH = dt.date(1970, 1, 1)
TABLE = "spec string, date date, estimator string, ticket string, lag int, beta double, instead double"


def carried(growth: DataFrame, until: str | None = None, step: int = 1, of: DataFrame | None = None) -> DataFrame:
    """(ticket, date, value, seen) for every month, or every `step` months, from the panel's first to its last, or to `until`: the last observed value,
    before the first one that one; seen is how many months were observed up to it. Tickets never observed drop out. With `of`,
    a table of few rows, only its tickets are carried, on the calendar of all."""
    g = growth.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select("ticket", "date", F.col("value").cast("double").alias("value"))
    span = g.agg(F.min("date").alias("a"), F.greatest(F.max("date"), F.to_date(F.lit(until))).alias("b") if until else F.max("date").alias("b")).filter("a is not null")
    months = span.select(F.explode(F.sequence("a", "b", F.expr(f"interval {step} month"))).alias("date"))
    if of is not None:
        g = g.join(F.broadcast(of.select("ticket").distinct()), "ticket", "left_semi")
    x = g.select("ticket").distinct().join(F.broadcast(months)).join(g, ["ticket", "date"], "left")
    back, ahead = W.partitionBy("ticket").orderBy("date").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("ticket").orderBy("date").rowsBetween(0, W.unboundedFollowing)
    return x.select("ticket", "date", F.coalesce(F.last("value", True).over(back), F.first("value", True).over(ahead)).alias("value"), F.count("value").over(back).alias("seen"))


def weight(date, decay: float = DECAY):
    """decay to the age in quarters, up to a factor that no line depends on."""
    return F.pow(F.lit(decay), -F.datediff(date, F.lit("1970-01-01")) / 90.0 + 100)


def lines(panel: DataFrame, target: DataFrame, decay: float = DECAY) -> DataFrame:
    """The coefficient table of cells of one ticket each, least squares on its own month; spec is the ticket.

    One running window by ticket fits all quarters: the weights of two quarters have one ratio, whenever they are fitted.
    panel as carried() gives it.
    """
    y = target.filter("y is not null").select("date", F.col("y").cast("double").alias("y"))
    x = panel.join(F.broadcast(y), "date").withColumn("w", weight(F.col("date"), decay))
    past = W.partitionBy("ticket").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    sums = {"n": F.count("*"), "s": F.sum("w"), "sx": F.sum(F.col("w") * F.col("value")), "sy": F.sum(F.col("w") * F.col("y")), "sxx": F.sum(F.col("w") * F.col("value") ** 2), "sxy": F.sum(F.col("w") * F.col("value") * F.col("y"))}
    x = x.select("ticket", "date", F.lag("seen").over(W.partitionBy("ticket").orderBy("date")).alias("seen"), *[v.over(past).alias(k) for k, v in sums.items()])
    spread = F.col("s") * F.col("sxx") - F.col("sx") ** 2
    x = x.filter((F.col("n") >= QUARTERS) & (F.col("seen") >= SEEN) & (spread > 0)).withColumn("b", (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread)
    x = x.withColumn("c", (F.col("sy") - F.col("b") * F.col("sx")) / F.col("s"))
    terms = F.array(F.struct(F.col("ticket").alias("ticket"), F.col("b").alias("beta")), F.struct(F.lit(CONSTANT).alias("ticket"), F.col("c").alias("beta")))
    x = x.select(F.col("ticket").alias("spec"), "date", F.explode(terms).alias("t"))
    return x.select("spec", "date", F.lit("OLS").alias("estimator"), "t.ticket", F.lit(0).alias("lag"), "t.beta", F.lit(None).cast("double").alias("instead"))


def designs(groups: DataFrame) -> DataFrame:
    """(spec, method, size, factors, flat, lags, estimators): every group in every design.

    groups: (method, size, score). Specifications are named after method and size, the one with the least score `bench`, and
    the design; factors must be fewer than series. Designs: three months each, four (`flats`), five or three factors (`p5`,
    `p3`), five factors with two quarters of the target (`p5l2`).
    """
    spark = groups.sparkSession
    grid = spark.createDataFrame([("", 0, 3, 0), ("flats", 0, 4, 0), ("p5", 5, 3, 0), ("p3", 3, 3, 0), ("p5l2", 5, 3, 2)], "design string, factors int, flat int, lags int")
    best = groups.agg(F.min(F.struct("score", "method", "size")).alias("best"))
    stem = F.when((F.col("method") == F.col("best.method")) & (F.col("size") == F.col("best.size")), "bench").otherwise(F.col("method"))
    x = groups.join(F.broadcast(best)).join(F.broadcast(grid)).filter((F.col("factors") == 0) | (F.col("factors") < F.col("size")))
    return x.select(F.concat(stem, F.col("size").cast("string"), "design").alias("spec"), "method", "size", "factors", "flat", "lags", F.array(*map(F.lit, LINES)).alias("estimators"))


def _stamp(day: int) -> dt.date:
    return EPOCH + dt.timedelta(days=int(day))


def fit(months: np.ndarray, at: np.ndarray, y: np.ndarray, own: np.ndarray, w: np.ndarray, flat: int, factors: int, estimators: list[str], lines: dict[str, Estimator] = LINES) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """By estimator: constant, coefficients (tickets x months back), coefficients of own lags.

    months: tickets x months up to the last quarter learned from; at: column of each quarter. Factors come from all these
    months, standardised; their lines are written out in the tickets, so a reading never needs the factors.
    """
    base, back = months, None
    if factors:
        z, mean, sd = standardised(months.T)
        axes = np.linalg.svd(z, full_matrices=False)[2][:factors]
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        base, back = axes @ z.T, (axes / sd, mean)
    x = np.column_stack([base[:, at - k].T for k in range(flat)] + ([own] if own.size else []))
    k = len(base)
    out = {}
    for e in estimators:
        c, b = lines[e](x, y, w)
        beta, rest = b[: k * flat].reshape(flat, k).T, b[k * flat :]
        if back is not None:
            beta = back[0].T @ beta
            c -= float((back[1][:, None] * beta).sum())
        out[e] = (float(c), beta, rest)
    return out


def coefficients(specs: DataFrame, members: DataFrame, panel: DataFrame, target: DataFrame, first: str, last: str | None = None, leave: str | None = None, decay: float = DECAY, lines: dict[str, Estimator] = LINES, live: str | None = None) -> DataFrame:
    """The coefficient table (spec, date, estimator, ticket, lag, beta, instead) of all specifications at each quarter of the
    target from `first` on; `instead` stands for a quarter of the target that is not known.

    specs as designs() gives them; members: (method, ticket, rank), the first `size` of a method are a group's tickets, or
    (method, as_of, ticket, rank), where the latest ranking at or before the test quarter counts, else the earliest. panel as
    carried() gives it. A cell learns from quarters before its own; tickets with fewer than SEEN observed months by then are
    left out, as is quarter `leave`, if given. A cell is one row of arrays per ticket, so it fits one task; the target's
    quarters, few by nature, come to the driver. lines: the functions of (x, y, w) behind
    the names of estimators; any function that returns a constant and coefficients can be one. live: one more quarter, which
    needs no print, whose cells learn from all prints before it.
    """
    rows = target.filter("y is not null").select("date", F.col("y").cast("double")).orderBy("date").collect()
    days, ys = np.array([(r[0] - EPOCH).days for r in rows]), np.array([r[1] for r in rows])
    start = panel.agg(F.min("date")).first()[0]
    tests = [r[0] for r in rows if str(r[0]) >= first and (last is None or str(r[0]) <= last)]
    if live and dt.date.fromisoformat(live) not in tests:
        tests.append(dt.date.fromisoformat(live))
    if start is None or not rows or not tests:
        return panel.sparkSession.createDataFrame([], TABLE)
    place = np.array([(r[0].year - start.year) * 12 + r[0].month - start.month for r in rows])
    gone = (dt.date.fromisoformat(leave) - EPOCH).days if leave else None
    x = panel.groupBy("ticket").agg(F.array_sort(F.collect_list(F.struct("date", "value", "seen"))).alias("m"))
    x = x.select("ticket", F.transform("m", lambda s: s["value"]).alias("v"), F.transform("m", lambda s: s["seen"]).alias("seen"))
    dates = panel.sparkSession.createDataFrame([(t,) for t in tests], "date date")
    named = specs.join(F.broadcast(dates)).join(_members_at(members, dates), ["method", "date"] if "as_of" in members.columns else ["method"]).filter(F.col("rank") <= F.col("size"))
    known = months_between(F.col("date"), F.lit(start)) - 2  # months up to the quarter before
    named = named.join(x, "ticket").withColumn("v", F.slice("v", F.lit(1), F.greatest(known, F.lit(0)))).filter((known > 0) & (F.get("seen", known - 1) >= SEEN))
    cell = named.select("spec", F.datediff("date", F.lit("1970-01-01")).alias("day"), "ticket", "v", "factors", "flat", "lags", "estimators")

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("ticket", ignore_index=True)
        day, flat, factors, lags = (int(t[c].iloc[0]) for c in ("day", "flat", "factors", "lags"))
        months = np.stack(t["v"].to_list())
        use = (days < day) & (place >= flat - 1) & (place < months.shape[1])
        if gone is not None:
            use &= days != gone
        empty = pd.DataFrame({c.split()[0]: [] for c in TABLE.split(", ")}).astype({"lag": "int32"})
        if use.sum() < QUARTERS or (factors and factors >= len(months)):
            return empty
        own = np.column_stack([_earlier(days, place, ys, 3 * (k + 1), day)[use] for k in range(1, lags + 1)]) if lags else np.zeros((0, 0))
        means = np.nanmean(own, axis=0) if lags else np.zeros(0)
        own = np.where(np.isnan(own), means, own) if lags else own
        w = decay ** ((days[use].max() - days[use]) / 90.0)
        out = []
        for name, (c, beta, rest) in fit(months, place[use], ys[use], own, w, flat, factors, list(t["estimators"].iloc[0]), lines).items():
            out += [(name, CONSTANT, 0, c, None)] + [(name, v, k, float(beta[i, k]), None) for i, v in enumerate(t["ticket"]) for k in range(flat)]
            out += [(name, OWN, k + 1, float(rest[k]), float(means[k])) for k in range(lags)]
        done = pd.DataFrame(out, columns=["estimator", "ticket", "lag", "beta", "instead"]).astype({"lag": "int32", "instead": "float64"})
        done.insert(0, "spec", t["spec"].iloc[0])
        done.insert(1, "date", _stamp(day))
        return done

    return cell.groupBy("spec", "day").applyInPandas(one, TABLE).withColumn("instead", F.nanvl("instead", F.lit(None)))


def _members_at(members: DataFrame, dates: DataFrame) -> DataFrame:
    if "as_of" not in members.columns:
        return members
    when = members.select("method", "as_of").distinct().join(F.broadcast(dates))
    then = when.groupBy("method", "date").agg(F.coalesce(F.max(F.when(F.col("as_of") <= F.col("date"), F.col("as_of"))), F.min("as_of")).alias("as_of"))
    return members.join(then, ["method", "as_of"]).drop("as_of")


def _earlier(days: np.ndarray, place: np.ndarray, ys: np.ndarray, months: int, before: int) -> np.ndarray:
    """The target `months` before each quarter, nan where it is not there or not before the test quarter."""
    at = {int(p): v for p, v, d in zip(place, ys, days, strict=True) if d < before}
    return np.array([at.get(int(p) - months, np.nan) for p in place])


def readings(table: DataFrame, panel: DataFrame, meta: DataFrame, own: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """(date, vintage, spec, estimator, pred) of the coefficient table at every vintage, or at the (date, vintage) of `at`.

    meta: (ticket, months_lag), one month where it is missing. own: (date, vintage, l, y), the l-th last printed quarter of
    the target as known then. With `at`, quarters take the table of their own date if there is one, else the last one's:
    so unprinted quarters are read with the models of the last test quarter.
    """
    if at is None:
        x = table.withColumn("vintage", F.explode(F.array(*map(F.lit, vintage.VINTAGES))))
    else:
        have = table.select(F.col("date").alias("fitted")).distinct()
        use = at.join(F.broadcast(have), F.col("fitted") <= F.col("date")).groupBy("date", "vintage").agg(F.max("fitted").alias("fitted"))
        x = table.withColumnRenamed("date", "fitted").join(F.broadcast(use), "fitted").drop("fitted")
    x = x.join(meta.select("ticket", "months_lag"), "ticket", "left")
    gone = F.greatest(F.col("lag"), F.coalesce("months_lag", F.lit(1)) - F.col("vintage"))
    series = x.filter(~F.col("ticket").isin(CONSTANT, OWN)).withColumn("month", F.add_months("date", -gone))
    # the panel starts with the first month of any ticket; readings before it take that month, as gaps there do
    start = F.broadcast(panel.agg(F.min("date").alias("_a")))
    series = series.join(start).withColumn("month", F.greatest("month", "_a"))
    key = ["spec", "date", "vintage", "estimator"]
    parts = series.join(panel.select("ticket", F.col("date").alias("month"), "value"), ["ticket", "month"]).select(*key, (F.col("beta") * F.col("value")).alias("part"))
    parts = parts.unionByName(x.filter(F.col("ticket") == CONSTANT).select(*key, F.col("beta").alias("part")))
    lagged = x.filter(F.col("ticket") == OWN)
    if own is not None:
        lagged = lagged.join(F.broadcast(own.select("date", "vintage", F.col("l").alias("lag"), F.col("y").alias("_y"))), ["date", "vintage", "lag"], "left")
        parts = parts.unionByName(lagged.select(*key, (F.col("beta") * F.coalesce("_y", "instead")).alias("part")))
    return parts.groupBy(*key).agg(F.sum("part").alias("pred")).select("date", "vintage", "spec", "estimator", "pred")


def left_out(specs: DataFrame, members: DataFrame, panel: DataFrame, target: DataFrame, shock: str, after: str, meta: DataFrame) -> DataFrame:
    """(spec, estimator, shock_date, actual, predicted, residual): each cell refitted without a quarter inside its sample, and
    its error there. Cells are those of quarter `after`; the quarter is read with its months as they were in the end."""
    table = written(coefficients(specs, members, panel, target, after, after, leave=shock))
    moved = table.withColumn("date", F.to_date(F.lit(shock)))
    none = meta.select("ticket", F.lit(-99).alias("months_lag"))
    own = target.filter("y is not null").select(F.add_months("date", 6).alias("d1"), F.add_months("date", 9).alias("d2"), "y")
    own = own.select(F.explode(F.array(F.struct(F.col("d1").alias("date"), F.lit(1).alias("l")), F.struct(F.col("d2").alias("date"), F.lit(2).alias("l")))).alias("s"), "y").select("s.date", F.lit(0).alias("vintage"), "s.l", "y")
    at = panel.sparkSession.createDataFrame([(dt.date.fromisoformat(shock), 0)], "date date, vintage int")
    # every ticket of the table needs a lag, or it would be taken as published a month late
    all_known = table.select("ticket").distinct().join(none, "ticket", "left").select("ticket", F.lit(-99).alias("months_lag"))
    r = readings(moved, panel, all_known, own, at)
    return r.join(F.broadcast(target.select("date", "y")), "date").select("spec", "estimator", F.col("date").alias("shock_date"), F.col("y").alias("actual"), F.col("pred").alias("predicted"), (F.col("pred") - F.col("y")).alias("residual"))


def live_grid(target: DataFrame, cut: str, months_to_print: int, desired: str) -> DataFrame:
    """(date, vintage) of the quarters behind the last one printed at the cut, up to `desired`, each read at the cut; the
    vintage is at most the last of the grid. A quarter is printed if its value is there and its months to print have gone by.
    Without any print the grid starts with the quarter of the cut."""
    day = F.to_date(F.lit(cut))
    out = F.add_months("date", months_to_print) <= day
    last = target.agg(F.max(F.when(out & F.col("y").isNotNull(), F.col("date"))).alias("last"))
    first = F.coalesce(F.add_months("last", 3), F.add_months(F.trunc(day, "QUARTER"), 2))
    q = last.select(first.alias("a")).filter(F.col("a") <= F.to_date(F.lit(desired))).select(F.explode(F.sequence("a", F.to_date(F.lit(desired)), F.expr("interval 3 months"))).alias("date"))
    return q.select("date", F.least(months_between(day, F.col("date")), F.lit(max(vintage.VINTAGES))).cast("int").alias("vintage"))


def design_rows(specs: DataFrame, members: DataFrame, panel: DataFrame, target: DataFrame, meta: DataFrame, first: str, decay: float = DECAY) -> DataFrame:
    """(cell, spec, date, id, y, w, x) for estimators that are not lines: of every cell the quarters it learns from, named by
    their day, and its readings without y, named by their vintage. x holds each ticket's months, month by month, by ticket.

    Arguments as in coefficients() and readings(); designs with factors or lags of the target are left out.
    """
    y = target.filter("y is not null").select(F.col("date").alias("q"), F.col("y").cast("double").alias("y"))
    dates = y.filter(F.col("q") >= F.to_date(F.lit(first))).select(F.col("q").alias("date"))
    plain = specs.filter("factors = 0 and lags = 0")
    named = plain.join(F.broadcast(dates)).join(_members_at(members, dates), ["method", "date"] if "as_of" in members.columns else ["method"]).filter(F.col("rank") <= F.col("size"))
    before = panel.filter(F.col("seen") >= SEEN).select("ticket", F.add_months("date", 3).alias("date"))
    terms = named.join(before, ["ticket", "date"], "left_semi").select("spec", "date", "ticket", F.explode(F.sequence(F.lit(0), F.col("flat") - 1)).alias("lag"))
    past = terms.join(F.broadcast(y), F.col("q") < F.col("date")).select("spec", "date", "ticket", "lag", F.datediff("q", F.lit("1970-01-01")).cast("long").alias("id"), "y", weight(F.col("q"), decay).alias("w"), F.add_months("q", -F.col("lag")).alias("month"))
    now = terms.join(meta.select("ticket", "months_lag"), "ticket", "left").withColumn("id", F.explode(F.array(*[F.lit(v).cast("long") for v in vintage.VINTAGES])))
    gone = F.greatest(F.col("lag"), (F.coalesce("months_lag", F.lit(1)) - F.col("id")).cast("int"))
    now = now.select("spec", "date", "ticket", "lag", "id", F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("w"), F.add_months("date", -gone).alias("month"))
    start = F.broadcast(panel.agg(F.min("date").alias("_a")))
    x = past.unionByName(now).join(start).withColumn("month", F.greatest("month", "_a"))
    x = x.join(panel.select("ticket", F.col("date").alias("month"), "value"), ["ticket", "month"])
    x = x.groupBy("spec", "date", "id").agg(F.first("y").alias("y"), F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("lag", "ticket", "value"))).alias("m"))
    return x.select(F.concat_ws(" ", "spec", F.col("date").cast("string")).alias("cell"), "spec", "date", "id", "y", "w", F.transform("m", lambda s: s["value"]).alias("x"))
