"""Readings that arrive in files: Structured Streaming over what is there, state in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)


def _drain(stream: DataFrame, state: str, batch, mode: str = "append") -> None:
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()


def latest(spark: SparkSession, path: str, state: str) -> DataFrame:
    """(user_id, date, event_id, value): of the readings of a site and day the one with the largest event_id. The table lies
    by month; a batch reads and replaces the months it touches only, by way of a written copy, so a batch that runs again
    gives the same."""
    table = f"{state}/table"

    def upsert(new: DataFrame, k: int) -> None:
        x = new.withColumn("month", F.date_format("date", "yyyyMM").cast("int"))
        if k:
            touched = F.broadcast(x.select("month").distinct())  # months, few by nature
            x = x.unionByName(new.sparkSession.read.parquet(table).join(touched, "month", "left_semi").select(*x.columns))
        x = x.groupBy("month", "user_id", "date").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("x"))
        x.select("month", "user_id", "date", "x.event_id", "x.value").write.mode("overwrite").parquet(f"{state}/batch-{k}")
        done = new.sparkSession.read.parquet(f"{state}/batch-{k}").repartition("month", F.pmod(F.hash("user_id"), F.lit(8)))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(table)

    _drain(_files(spark, path), state, upsert)
    return spark.read.parquet(table).select("user_id", "date", "event_id", "value")


def complete_days(spark: SparkSession, path: str, state: str, tiles: int = 4, late: str = "40 days") -> DataFrame:
    """(date, tiles, complete): tiles seen of each day. A day that is read again replaces its row; days older than the
    watermark are closed."""
    seen = _files(spark, path).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), F.to_date("ts").alias("date"))
    days = seen.agg(F.collect_set("tile").alias("seen")).select(F.col("window.start").alias("start"), "date", "seen")

    def put(new: DataFrame, k: int) -> None:
        new.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{state}/days/batch-{k}")

    _drain(days, state, put, "update")
    x = spark.read.option("recursiveFileLookup", "true").parquet(f"{state}/days")
    x = x.groupBy("date", "start").agg(F.max_by("seen", "batch").alias("seen")).groupBy("date")  # a day may meet two windows
    x = x.agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).cast("long").alias("tiles"))
    return x.withColumn("complete", F.col("tiles") == tiles)


def known_at(spark: SparkSession, path: str, state: str, reading: str) -> DataFrame:
    """(ticket, date, value) of what was published by the reading, taken from the stream of publications."""
    known = _files(spark, path).filter(F.col("published") <= F.to_date(F.lit(reading))).select("ticket", "date", "value")

    def put(new: DataFrame, k: int) -> None:
        new.write.mode("overwrite").parquet(f"{state}/known/batch-{k}")

    _drain(known, state, put)
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{state}/known")


def monthly(spark: SparkSession, path: str, state: str, late: str = "40 days") -> DataFrame:
    """(month, event_type, n, mean) of readings as they arrive. A month is no window of fixed length, so the state is sums of
    days, which close with the watermark; months add up the latest row of each day. Null values count but have no mean."""
    x = _files(spark, path).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), F.trunc("ts", "MONTH").alias("month"), "event_type")
    days = x.agg(F.count("*").alias("n"), F.count("value").alias("k"), F.sum("value").alias("s")).select(F.col("window.start").alias("start"), "month", "event_type", "n", "k", "s")

    def put(new: DataFrame, k: int) -> None:
        new.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{state}/sums/batch-{k}")

    _drain(days, state, put, "update")
    x = spark.read.option("recursiveFileLookup", "true").parquet(f"{state}/sums")
    x = x.groupBy("start", "month", "event_type").agg(F.max_by(F.struct("n", "k", "s"), "batch").alias("x"))
    return x.groupBy("month", "event_type").agg(F.sum("x.n").alias("n"), (F.sum("x.s") / F.nullif(F.sum("x.k"), F.lit(0))).alias("mean"))
