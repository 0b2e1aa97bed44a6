"""Which ranked sets go on from the race: those that beat the benchmark, what their methods agree on, fixed groups, and the
readings of chosen sizes beside the pool.

scores: (method, size, mse, ratio) as the race gives them; rankings: (method, ticket, rank). Both are small: a method ranks
at most as many tickets as the race tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMMON, SHARED = "common", "shared"


def beating(scores: DataFrame, keys: list[str], error: str, ratio: str = "ratio", fallback: int = 15) -> DataFrame:
    """Rows whose ratio is below 1; where there are none at all, the `fallback` ones of least error, ties by keys.

    Rows of null ratio or error never count as better, and come last among the fallback.
    """
    some = scores.agg(F.coalesce(F.max((F.col(ratio) < 1).cast("int")), F.lit(0)).alias("_some"))
    best = scores.orderBy(F.asc_nulls_last(error), *keys).limit(fallback).join(F.broadcast(some)).filter("_some = 0").drop("_some")
    return scores.filter(F.col(ratio) < 1).unionByName(best)


def closest(scores: DataFrame, keys: list[str], ratio: str = "ratio", most: int = 3) -> DataFrame:
    """The rows whose ratio is closest to 1, ties by keys."""
    return scores.filter(F.col(ratio).isNotNull()).orderBy(F.abs(F.col(ratio) - 1), *keys).limit(most)


def agreed(rankings: DataFrame, scores: DataFrame, least: int = 3) -> DataFrame:
    """(name, ticket, rank, needed, methods): consensus groups of the methods that beat the benchmark.

    A beating method stands for the largest of its sizes with a ratio below 1. `common` holds the tickets of all of them,
    `shared` those of all but one, two at least. A group needs `least` tickets, the shared one more than the common one.
    Tickets are ordered by the sum of their ranks in the beating methods' whole rankings, then by name.
    """
    last = scores.filter("ratio < 1").groupBy("method").agg(F.max("size").alias("_size"))
    t = rankings.join(F.broadcast(last), "method").groupBy("ticket").agg(F.count_if(F.col("rank") <= F.col("_size")).alias("methods"), F.sum("rank").alias("_ranks"))
    t = t.join(F.broadcast(last.agg(F.count("*").alias("_all")))).withColumn("name", F.explode(F.array(F.lit(COMMON), F.lit(SHARED))))
    needed = F.when(F.col("name") == COMMON, F.col("_all")).otherwise(F.greatest(F.col("_all") - 1, F.lit(2)))
    t = t.withColumn("needed", needed).filter((F.col("methods") > 0) & (F.col("methods") >= F.col("needed")))
    n = t.groupBy().agg(F.count_if(F.col("name") == COMMON).alias("_common"), F.count_if(F.col("name") == SHARED).alias("_shared"))
    size = F.when(F.col("name") == COMMON, F.col("_common")).otherwise(F.col("_shared"))
    t = t.join(F.broadcast(n)).filter((size >= least) & ((F.col("name") == COMMON) | (F.col("_shared") > F.col("_common"))))
    rank = F.row_number().over(W.partitionBy("name").orderBy("_ranks", "ticket"))
    return t.select("name", "ticket", rank.alias("rank"), "needed", "methods")


def kept(groups: DataFrame, scores: DataFrame) -> DataFrame:
    """Of the consensus groups, with the race's score of each at its own size, the common one always and the shared one if
    its ratio is below 1: (method, size, tickets, mse, ratio)."""
    whole = groups.groupBy(F.col("name").alias("method")).agg(F.count("*").cast("int").alias("size"), F.array_sort(F.collect_list(F.struct("rank", "ticket"))).alias("t"))
    x = whole.join(scores, ["method", "size"]).filter((F.col("method") == COMMON) | (F.col("ratio") < 1))
    return x.select("method", "size", F.array_join(F.transform("t", lambda s: s["ticket"]), " ").alias("tickets"), "mse", "ratio")


def fixed(groups: DataFrame, panel: DataFrame) -> DataFrame:
    """(spec, size, selected, missing): groups written down by hand, (spec, tickets) with blanks between tickets, split into
    those the panel has and those it lacks, in the order written. A ticket named twice counts once; a group of null or
    empty text has size 0."""
    words = F.array_distinct(F.filter(F.split(F.coalesce("tickets", F.lit("")), r"\s+"), lambda t: t != ""))
    x = groups.select("spec", F.posexplode_outer(words).alias("_i", "ticket"))
    have = panel.select("ticket").join(F.broadcast(x.select("ticket").distinct()), "ticket", "left_semi").distinct().withColumn("_in", F.lit(True))
    x = x.join(have, "ticket", "left")

    def text(there: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(there & F.col("ticket").isNotNull(), F.struct("_i", "ticket"))))
        return F.array_join(F.transform(rows, lambda s: s["ticket"]), " ")

    return x.groupBy("spec").agg(F.count("_in").alias("size"), text(F.col("_in").isNotNull()).alias("selected"), text(F.col("_in").isNull()).alias("missing"))


def sized_panel(readings: DataFrame, methods: list[str], sizes: list[int], estimators: list[str], vintage: int, plain: bool = True) -> DataFrame:
    """(date, spec, estimator, k, pred, actual, panel_median, pool_median): readings at one vintage of the specifications
    `<method><k>`, with anything behind it unless plain, beside their own median and that of the whole pool.

    readings: (date, vintage, spec, estimator, pred, actual); quarters without such a reading are left out.
    """
    at = readings.filter(F.col("vintage") == vintage)
    pool = at.groupBy("date").agg(F.median("pred").alias("pool_median"))
    pattern = f"^(?:{'|'.join(methods)})([0-9]+)" + ("$" if plain else "")
    x = at.withColumn("k", F.regexp_extract("spec", pattern, 1).try_cast("int")).filter(F.col("k").isin(sizes) & F.col("estimator").isin(estimators))
    x = x.withColumn("panel_median", F.median("pred").over(W.partitionBy("date"))).join(pool, "date")
    return x.select("date", "spec", "estimator", "k", "pred", "actual", "panel_median", "pool_median")


def by_method(scores: DataFrame) -> DataFrame:
    """By method: sizes that beat the benchmark, the best ratio and its smallest size, the median ratio."""
    return scores.filter("ratio is not null").groupBy("method").agg(F.count_if(F.col("ratio") < 1).alias("better"), F.min("ratio").alias("best"), F.min_by("size", F.struct("ratio", "size")).alias("best_size"), F.median("ratio").alias("mid"))


def weighted_by_distance(models: DataFrame) -> DataFrame:
    """(date, n, mean, weighted, actual) over models of one indicator each: the plain mean, and the mean weighted by how far
    a model's error in its sample lies below the worst one's; equal weights where all errors are equal.

    models: (ticket, date, pred, actual), rows of null pred or actual skipped.
    """
    x = models.filter("pred is not null and actual is not null")
    e = x.groupBy("ticket").agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("actual"), F.lit(2)))).alias("rmse"))
    top = e.agg(F.max("rmse").alias("_worst"), F.min("rmse").alias("_least"))
    w = e.join(F.broadcast(top)).select("ticket", F.when(F.col("_worst") > F.col("_least"), F.col("_worst") - F.col("rmse")).otherwise(F.lit(1.0)).alias("w"))
    x = x.join(w, "ticket").groupBy("date").agg(F.count("*").alias("n"), F.avg("pred").alias("mean"), F.sum(F.col("w") * F.col("pred")).alias("_s"), F.sum("w").alias("_w"), F.max("actual").alias("actual"))
    return x.select("date", "n", "mean", F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).alias("weighted"), "actual")


def two_sided(t: Column, df: Column) -> Column:
    """The two-sided p-value of a t statistic with a whole number of degrees of freedom, from the finite sums in powers of
    the cosine of atan(t / sqrt(df)); null without degrees of freedom."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c2 = F.pow(F.cos(angle), F.lit(2))
    odd = df % 2 == 1
    terms = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    steps = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>"))
    # the state carries all that the steps need: a column named in a lambda would mean an alias of that name in the same select
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"), c2.alias("c2"), odd.alias("odd"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * s["c2"] * F.when(s["odd"], 2 * k / (2 * k + 1.0)).otherwise((2 * k - 1) / (2.0 * k))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"), s["c2"].alias("c2"), s["odd"].alias("odd"))

    grow = F.aggregate(steps, start, step, lambda s: s["sum"])
    inside = F.when(odd, 2 / F.pi() * (angle + F.when(terms > 0, F.sin(angle) * F.cos(angle) * grow).otherwise(F.lit(0.0)))).otherwise(F.sin(angle) * grow)
    return F.when(df > 0, F.greatest(1 - inside, F.lit(0.0)))
