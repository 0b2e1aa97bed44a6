"""Orders of entry by least angles, and the race of ranked sets over expanding folds.

Series are rows with one number a quarter; quarters are few, series are not. So what meets in one place is always of the size
of quarters: the path asks all series, step by step, for the one that enters next, and a fold judges a set by its kernel,
the quarters' products summed over its series.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.files import written


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def quarterly_rows(panel: DataFrame) -> DataFrame:
    """(ticket, x, seen): the panel of carried() with one array a series, seen the quarters observed up to each."""
    rows = panel.groupBy("ticket").agg(F.array_sort(F.collect_list(F.struct("date", "value", "seen"))).alias("m"))
    return rows.select("ticket", F.transform("m", lambda s: s["value"]).alias("x"), F.transform("m", lambda s: s["seen"]).alias("seen"))


def calendar(panel: DataFrame) -> list[dt.date]:
    return [r[0] for r in panel.select("date").distinct().orderBy("date").collect()]


def standard_rows(rows: DataFrame, quarters: list[dt.date], known: dict[dt.date, float], tests: list[dt.date], least: int = 8) -> DataFrame:
    """(as_of, ticket, x): each series on the quarters with a print before each test, with mean 0 and length 1; series with
    fewer than `least` observed quarters by then, or that do not vary, drop out."""
    places = [(t, [i + 1 for i, q in enumerate(quarters) if q < t and q in known]) for t in tests]
    at = rows.sparkSession.createDataFrame([p for p in places if p[1]], "as_of date, at array<int>")
    x = rows.join(F.broadcast(at)).filter(F.element_at("seen", F.element_at("at", -1)) >= least)
    x = x.select("as_of", "ticket", F.transform("at", lambda i: F.element_at("x", i)).alias("x"))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
    x = x.withColumn("m", mean).withColumn("x", F.transform("x", lambda v: v - F.col("m"))).withColumn("l", F.sqrt(_dot("x", "x")))
    return x.filter(F.col("l") > 1e-9).select("as_of", "ticket", F.transform("x", lambda v: v / F.col("l")).alias("x"))


class Walk:
    """The path of one target: chosen series with their signs, the fit so far, and the direction of equal angles."""

    def __init__(self, y: np.ndarray):
        self.y, self.fit = y - y.mean(), np.zeros(len(y))
        self.names: list[str] = []
        self.x = np.zeros((len(y), 0))
        self.level, self.angle, self.direction = 0.0, 0.0, np.zeros(len(y))

    def enter(self, name: str, x: np.ndarray, step: float) -> bool:
        """Walk `step` along the direction, then take a series in; false if it lies in the span of those chosen."""
        self.fit = self.fit + step * self.direction
        rest = self.y - self.fit
        together = np.column_stack([self.x, x * np.sign(x @ rest)])
        gram = together.T @ together
        if len(gram) >= len(self.y) or np.linalg.cond(gram) > 1e12:
            return False
        self.names.append(name)
        self.x, self.level = together, float(abs(x @ rest))
        w = np.linalg.solve(gram, np.ones(len(gram)))
        self.angle = float(1 / np.sqrt(w.sum()))
        self.direction = together @ (w * self.angle)
        return True


def entry_order(rows: DataFrame, quarters: list[dt.date], known: dict[dt.date, float], tests: list[dt.date], most: int) -> DataFrame:
    """(as_of, ticket, rank, score): series in order of entry on the path of least angles before each test quarter; score is
    the covariance that all chosen ones share when it enters. Ties go by ticket; a series in the span of those chosen is
    passed over.

    Each step is one pass over all series and all test quarters: a series' own step is where its covariance reaches the
    chosen ones'; the smallest one enters. One row a test quarter comes back.
    """
    spark = rows.sparkSession
    z = written(standard_rows(rows, quarters, known, tests))
    walks = {t: Walk(np.array([known[q] for q in quarters if q < t and q in known])) for t in tests if any(q < t and q in known for q in quarters)}
    passed: dict[dt.date, list[str]] = {t: [] for t in walks}
    open_, found = set(walks), []
    while open_:
        state = [(t, (w.y - w.fit).tolist(), w.direction.tolist(), w.level, w.angle, w.names + passed[t], not w.names) for t, w in sorted(walks.items()) if t in open_]
        now = spark.createDataFrame(state, "as_of date, rest array<double>, way array<double>, level double, angle double, used array<string>, first boolean")
        c, a = _dot("x", "rest"), _dot("x", "way")
        x = z.join(F.broadcast(now), "as_of").filter(~F.array_contains("used", F.col("ticket"))).select("as_of", "ticket", "x", "level", "angle", "first", c.alias("c"), a.alias("a"))
        near = lambda s: F.when(F.col("angle") - s * F.col("a") > 1e-12, F.greatest((F.col("level") - s * F.col("c")) / (F.col("angle") - s * F.col("a")), F.lit(0.0)))
        step = F.when(F.col("first"), -F.abs("c")).otherwise(F.least(near(1), near(-1)))
        best = x.withColumn("step", F.round(step, 12)).filter("step is not null").groupBy("as_of").agg(F.min_by(F.struct("ticket", "x", "step", "first"), F.struct("step", "ticket")).alias("b")).collect()
        got = {r["as_of"]: r["b"] for r in best}
        for t in list(open_):
            w, b = walks[t], got.get(t)
            if b is None or (not b["first"] and b["step"] > w.level / max(w.angle, 1e-300) + 1e-9):
                open_.discard(t)
            elif w.enter(b["ticket"], np.array(b["x"]), 0.0 if b["first"] else b["step"]):
                found.append((t, b["ticket"], len(w.names), w.level))
                if len(w.names) >= most:
                    open_.discard(t)
            elif len(w.names) + 1 >= len(w.y):
                open_.discard(t)
            else:
                passed[t].append(b["ticket"])
                w.direction, w.level, w.angle = w.direction, w.level - (0 if b["first"] else b["step"]) * w.angle, w.angle
    return spark.createDataFrame(found, "as_of date, ticket string, rank int, score double")


# --- the race ---------------------------------------------------------------------------------------------------------


def fold_starts(quarters: int, first: int = 16, step: int = 2, ahead: int = 4) -> list[int]:
    return list(range(first, quarters - ahead, step))


def fold_rows(x: np.ndarray, seen: np.ndarray, start: int, ahead: int, least: int, clip: float) -> np.ndarray:
    """Series of one fold, admitted, standardised on the quarters before its start, clipped, and centred there again."""
    x = x[seen[:, start - 1] >= least][:, : start + ahead]
    train = x[:, :start]
    sd = train.std(1, keepdims=True)
    z = np.clip((x - train.mean(1, keepdims=True)) / np.where(sd > 0, sd, 1.0), -clip, clip)
    return z - z[:, :start].mean(1, keepdims=True)


def judged(kernel: np.ndarray, y: np.ndarray, start: int, series: int, factors: int) -> float:
    """Mean squared error behind `start` of the line on principal components, all from the kernel of the series."""
    have = ~np.isnan(y)
    mean = y[:start][have[:start]].mean()
    off = y[start:][have[start:]] - mean
    if series:
        values, vectors = np.linalg.eigh(kernel[:start, :start])
        k = min(factors, series, start - 1)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        on = values > 1e-9 * max(values[0], 1e-300)
        values, vectors = values[on], vectors[:, on]
        pull = vectors * (vectors.T @ (y[:start] - mean) / values)
        off = off - (kernel[start:, :start] @ pull.sum(1))[have[start:]]
    return float((off**2).mean())


def race(rankings: DataFrame, rows: DataFrame, y: np.ndarray, sizes: tuple[int, int] = (5, 99), factors: int = 5, first: int = 16, step: int = 2, ahead: int = 4, least: int = 8, clip: float = 5.0) -> DataFrame:
    """(method, size, mse, ratio): each ranking's first `size` series, judged by one recipe over expanding folds, and over the
    same judgement of all series.

    rankings: (method, ticket, rank); rows as quarterly_rows() gives them; y: the target by quarter, whole up to its last
    training quarter. A fold admits series with `least` observed quarters before its start; without any, the mean is the
    forecast. The panel is read once for all folds: every batch adds its series' products to each fold's kernel; ranked
    series are summed in order, so each size takes what the one before it had.
    """
    starts = fold_starts(len(y), first, step, ahead)
    spark = rows.sparkSession
    if not starts:
        return spark.createDataFrame([], "method string, size int, mse double, ratio double")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, seen = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for i in (0, 1))
            for s in starts:
                z = fold_rows(x, seen, s, ahead, least, clip)
                n, k = total.get(s, (0, 0.0))
                total[s] = [n + len(z), k + z.T @ z]
        for s, (n, k) in total.items():
            yield pa.RecordBatch.from_pydict({"start": pa.array([s] * k.size, pa.int32()), "i": pa.array(np.arange(k.size), pa.int32()), "v": k.ravel(), "n": pa.array([n] * k.size, pa.int64())})

    sums = rows.select("x", "seen").mapInArrow(whole, "start int, i int, v double, n long").groupBy("start", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    errors = []
    for s, t in sums.groupby("start"):
        k = t.sort_values("i")["v"].to_numpy().reshape(s + ahead, s + ahead)
        errors.append(judged(k, y[: s + ahead], int(s), int(t["n"].iloc[0]), factors))
    if not errors:
        return spark.createDataFrame([], "method string, size int, mse double, ratio double")
    benchmark = float(np.mean(errors))

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("rank", ignore_index=True)
        x, seen, rank = np.stack(t["x"].to_list()), np.stack(t["seen"].to_list()), t["rank"].to_numpy()
        error = np.zeros((sizes[1] - sizes[0] + 1, len(starts)))
        for f, s in enumerate(starts):
            kernel, n, at = np.zeros((s + ahead, s + ahead)), 0, 0
            for size in range(1, sizes[1] + 1):
                while at < len(rank) and rank[at] <= size:
                    z = fold_rows(x[at : at + 1], seen[at : at + 1], s, ahead, least, clip)
                    kernel, n, at = kernel + z.T @ z, n + len(z), at + 1
                if size >= sizes[0]:
                    error[size - sizes[0], f] = judged(kernel, y[: s + ahead], s, n, factors)
        last = int(min(sizes[1], rank.max()))
        return pd.DataFrame({"method": t["method"].iloc[0], "size": np.arange(sizes[0], last + 1, dtype=np.int32), "mse": error[: max(last - sizes[0] + 1, 0)].mean(1)})

    ranked = rankings.filter(F.col("rank") <= sizes[1]).join(rows, "ticket").select("method", "rank", "x", "seen")
    return ranked.groupBy("method").applyInPandas(one, "method string, size int, mse double").withColumn("ratio", F.col("mse") / F.lit(benchmark))


def ranked(scores: DataFrame, keep: int) -> DataFrame:
    """(as_of, ticket, score, rank) of the best `keep` of each as_of, ties by ticket."""
    rank = F.row_number().over(W.partitionBy("as_of").orderBy(F.desc("score"), "ticket"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= keep).select("as_of", "ticket", "score", "rank")
