"""Structured Streaming over the event log: daily counts, sessions' rates and incremental indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_counts(events: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """(day, event_type, n): tumbling days; an event later than delay behind the newest is dropped, as state must end."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counted = timed.groupBy(F.window(ts, "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.to_date("w.start").alias("day"), "event_type", "n")


def first_seen(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events without repeats of their key within the delay."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def rates(events: DataFrame, key: str, ts: str = "ts", span: str = "10 minutes", slide: str = "5 minutes", most: int = 100, delay: str = "1 hour") -> DataFrame:
    """(key, start, n, limited): events of each key in sliding spans, and whether they are over the limit."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counted = timed.groupBy(F.window(ts, span, slide).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), "n", (F.col("n") > most).alias("limited"))


def merged_into(path: str, key: str):
    """A foreachBatch function that keeps in path, one folder a batch, the newest version of each key: (old less changed) plus changes.

    Each batch writes a new folder and then names it in path/_current, so readers never see half a table and a repeated batch
    gives the same folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = f"{path}/batch={number:012d}"
        changes = batch.dropDuplicates([key])
        last = current(spark, path, before=number)
        whole = changes if last is None else last.join(changes.select(key), key, "left_anti").unionByName(changes)
        whole.write.mode("overwrite").parquet(name)
        spark.createDataFrame([(name, number)], "name string, number long").coalesce(1).write.mode("append").json(f"{path}/_current")

    return run


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table that the last batch (before a number) left, or None."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    done = spark.read.schema("name string, number long").json(f"{path}/_current")
    if before is not None:
        done = done.where(F.col("number") < before)
    row = done.orderBy(F.desc("number")).first()
    return spark.read.parquet(row.name) if row else None
