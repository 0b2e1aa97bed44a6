"""Queries that write the given tables as files and scan them again, and arrival of readings as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.pool_queries import POOL, readings
from tidemark.plans.queries import query
from tidemark.sources import files
from tidemark.streaming import arrivals
from tidemark.testbed import daily, meta, obs, read


@query("s01_csv_scan", " SELECT ticket, date, value FROM obs")
def s01(s, d):
    """Every series comes twice in the files; the later row of a date counts."""
    o, path = obs(s, d), files.folder(s)
    text = F.date_format("date", "M/d/yyyy").alias("date")
    o.select(F.lit(0).alias("seq"), "ticket", text, (F.col("value") * 2).alias("value")).unionByName(o.select(F.lit(1).alias("seq"), "ticket", text, "value")).write.csv(path, header=True)
    return files.csv_series(s, path)


@query("s02_glob", " SELECT agg_method AS source, ticket, date, value FROM obs JOIN meta USING (ticket)")
def s02(s, d):
    path = files.folder(s)
    o = obs(s, d).join(meta(s, d), "ticket")
    rows = o.select("ticket", "date", "value", F.col("agg_method").alias("source"))
    rows.unionByName(rows.filter("source = 'sum'").withColumn("source", F.lit("meta"))).write.partitionBy("source").csv(path, header=True)
    return files.csv_folders(s, path)


@query("s03_merged", " SELECT date, sum(value) FILTER (agg_method = 'mean') AS mean, sum(value) FILTER (agg_method = 'last') AS last, sum(value) FILTER (agg_method = 'sum') AS sum FROM obs JOIN meta USING (ticket) GROUP BY 1")
def s03(s, d):
    """Files of several sources merged to one panel by date."""
    return s02(s, d).groupBy("date").pivot("source", ["mean", "last", "sum"]).agg(F.sum("value"))


@query("s04_xml_scan", " SELECT ticket, date, value FROM obs")
def s04(s, d):
    path = files.folder(s)
    x = obs(s, d).groupBy(F.col("ticket").alias("_TICKET")).agg(F.collect_list(F.struct(F.col("value").alias("_OBS_VALUE"), F.col("date").cast("string").alias("_TIME_PERIOD"))).alias("Obs"))
    x.write.format("xml").option("rowTag", "Series").option("rootTag", "Data").save(path)
    return files.xml_observations(s, path)


@query("s05_json_scan", " SELECT ticket, date, CASE WHEN value >= 20 THEN value END AS value FROM obs")
def s05(s, d):
    """Small values are written as the text '.', which is no number."""
    path = files.folder(s)
    text = F.when(F.col("value") >= 20, F.col("value").cast("string")).otherwise(".")
    obs(s, d).groupBy("ticket").agg(F.collect_list(F.struct("date", text.alias("value"))).alias("observations")).write.json(path)
    return files.json_observations(s, path)


@query("s07_exports", ", x AS (SELECT sector AS term, date, ((2 * sum(CAST(round(value * 1000000) AS BIGINT)) + 1000 * count(value)) // (2000 * count(value))) / 1000.0 AS value FROM daily GROUP BY 1, 2) SELECT term, 'World' AS place, date, CASE WHEN value < 50 THEN 0 ELSE value END AS value FROM x")
def s07(s, d):
    path = files.folder(s)
    # readings have six places, so decimals give the exact mean, whatever the order of summation
    x = daily(s, d).groupBy("sector", "date").agg(F.round(F.avg(F.col("value").cast("decimal(20,6)")), 3).cast("double").alias("value"))
    row = F.concat_ws(",", F.col("date").cast("string"), F.when(F.col("value") < 50, "<1").otherwise(F.col("value").cast("string")))
    one = x.groupBy("sector").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    one.select("sector", F.concat(F.lit("Interest over time\n\nDay,"), "sector", F.lit(": (World)\n"), "rows").alias("value")).write.partitionBy("sector").text(path)
    return files.titled_exports(s, f"{path}/*")


@query("s11_wide_months", " SELECT agg_method, date, sum(value) AS value FROM obs JOIN meta USING (ticket) GROUP BY 1, 2")
def s11(s, d):
    path = files.folder(s)
    months = [f"{y}M{m:02}" for y in range(1995, 2002) for m in range(1, 13)]
    x = obs(s, d).join(meta(s, d), "ticket").withColumn("month", F.date_format("date", "yyyy'M'MM")).groupBy("agg_method").pivot("month", months)
    x.agg(F.sum("value")).write.csv(path, header=True)
    return files.wide_months(s, path, "agg_method")


@query("s16_panel_sink", " SELECT ticket, date, value, agg_method FROM obs JOIN meta USING (ticket)")
def s16(s, d):
    """Panel and metadata as Parquet, the panel in folders by method, and both read again."""
    path = files.folder(s)
    obs(s, d).join(meta(s, d).select("ticket", "agg_method"), "ticket").write.partitionBy("agg_method").parquet(f"{path}/panel")
    meta(s, d).write.parquet(f"{path}/meta")
    return s.read.parquet(f"{path}/panel").join(s.read.parquet(f"{path}/meta").select("ticket"), "ticket", "left_semi").select("ticket", "date", "value", "agg_method")


@query("s18_parameters", ", p AS (SELECT min(date) AS first, max(date) AS last, count(DISTINCT ticket) AS series FROM obs) SELECT * FROM p")
def s18(s, d):
    """The parameters of a run as JSON, written and parsed."""
    path = files.folder(s)
    p = obs(s, d).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("ticket").alias("series"))
    p.select(F.to_json(F.struct("first", "last", "series")).alias("value")).write.text(path)
    return s.read.text(path).select(F.from_json("value", "first date, last date, series long").alias("p")).select("p.*")


@query("s19_scoreboard", POOL + ", e AS (SELECT spec, vintage, round(sqrt(avg(pow(pred - actual, 2))), 5) AS rmse FROM readings GROUP BY 1, 2) SELECT spec, vintage, CASE WHEN vintage > 2 THEN rmse ELSE rmse + 1 END AS rmse FROM e")
def s19(s, d):
    """A stored table of scores; new scores of some cells take the place of theirs."""
    path = files.folder(s)
    e = readings(s, d).groupBy("spec", "vintage").agg(F.round(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("actual"), F.lit(2)))), 5).alias("rmse"))
    e.withColumn("rmse", F.col("rmse") + 1).write.parquet(path)
    return files.upserted(s.read.parquet(path), e.filter("vintage > 2"), ["spec", "vintage"], "rmse")


@query("s20_seeds", POOL + " SELECT date, vintage, spec, round(pred + seed, 6) AS pred, CAST(seed AS INTEGER) AS seed FROM readings, unnest([1, 2, 3]) AS t(seed)")
def s20(s, d):
    """Tables of several seeds, one file folder each, as one table with the seed."""
    path, r = files.folder(s), readings(s, d)
    for seed in (1, 2, 3):
        r.select("date", "vintage", "spec", F.round(F.col("pred") + seed, 6).alias("pred")).write.parquet(f"{path}/seed={seed}")
    return s.read.parquet(path).select("date", "vintage", "spec", "pred", F.col("seed").cast("int").alias("seed"))


@query("s21_named_months", " SELECT ticket, date, value FROM obs JOIN (SELECT ticket, min(date) + INTERVAL ((13 - month(min(date))) % 12) MONTH AS january FROM obs GROUP BY 1) USING (ticket) WHERE date >= january")
def s21(s, d):
    """Month names, and the year in January's row only; rows before the first January have no year."""
    path = files.folder(s)
    o = obs(s, d)
    c = o.groupBy("ticket").agg(F.min("date").alias("a"), F.max("date").alias("b")).select("ticket", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("date"))
    x = c.join(o, ["ticket", "date"], "left")
    x = x.select("ticket", ((F.year("date") - 1995) * 12 + F.month("date")).alias("line"), F.date_format("date", "MMMM").alias("month"), F.when(F.month("date") == 1, F.year("date")).alias("year"), "value")
    x.write.csv(path, header=True)
    rows = s.read.csv(path, header=True, schema="ticket string, line int, month string, year int, value double")
    return files.named_months(rows).filter("date is not null and value is not null")


@query("r01_stream", ", r AS (SELECT user_id, CAST(ts AS DATE) AS date, value, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) AS r FROM events) SELECT user_id, date, event_id, value FROM r WHERE r = 1")
def r01_stream(s, d):
    """Readings that arrive in files, upserted batch by batch: the same table as r01_latest_reading."""
    path = files.folder(s)
    read(s, d, "events").select("user_id", F.to_date("ts").alias("date"), "event_id", "value").repartition(4).write.parquet(path)
    return arrivals.latest(s, path, files.folder(s))


@query("r02_stream_tiles", " SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id % 4) AS tiles, count(DISTINCT user_id % 4) = 4 AS complete FROM events GROUP BY 1")
def r02_stream(s, d):
    """Days that are complete once all four tiles have arrived, counted while files arrive."""
    path = files.folder(s)
    read(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).alias("tile")).repartition(4).write.parquet(path)
    return arrivals.complete_days(s, path, files.folder(s))


@query("r04_stream_known", " SELECT ticket, date, value FROM obs JOIN meta USING (ticket) WHERE date + to_months(months_lag) <= DATE '2001-06-01'")
def r04_stream(s, d):
    """Published values arrive in the order of their publication, up to a reading."""
    path = files.folder(s)
    x = obs(s, d).join(meta(s, d), "ticket").select("ticket", "date", "value", F.add_months("date", F.col("months_lag")).alias("published"))
    x.repartitionByRange(4, "published").write.parquet(path)
    return arrivals.known_at(s, path, files.folder(s), "2001-06-01")


@query("r03_stream_months", " SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type, count(*) AS n, round(avg(value), 5) AS mean FROM events GROUP BY 1, 2")
def r03_stream(s, d):
    """The month's aggregate of readings, kept while files arrive."""
    path = files.folder(s)
    read(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").repartitionByRange(4, "ts").write.parquet(path)
    return arrivals.monthly(s, path, files.folder(s)).withColumn("mean", F.round("mean", 5))
