from pyspark.sql import functions as F

from lodestack.streaming import events as E


def ran(query):
    query.processAllAvailable()
    query.stop()


def test_daily_counts_agree_with_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(str(tmp_path / "in"))
    live = E.daily_counts(E.event_stream(spark, str(tmp_path / "in"), batch.schema), delay="3650 days")
    ran(live.writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).start())
    want = batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, want.collect()))


def test_repeats_are_dropped_and_rates_counted(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").limit(300)
    batch.union(batch).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.event_stream(spark, str(tmp_path / "in"), batch.schema)
    ran(E.first_seen(stream, delay="3650 days").writeStream.outputMode("append").format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).start())
    assert spark.table("once").count() == batch.select("event_id").distinct().count()
    over = E.rates(batch, "user_id", span="1 day", slide="1 day", most=1)
    assert over.where("limited AND n < 2 OR NOT limited AND n > 1").count() == 0


def test_merge_keeps_the_newest_of_each_key(spark, tmp_path):
    path = str(tmp_path / "table")
    put = E.merged_into(path, "k")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    assert E.current(spark, path) is None
    put(frame([(1, "a"), (2, "b")]), 0)
    put(frame([(2, "c"), (3, "d")]), 1)
    put(frame([(2, "c"), (3, "d")]), 1)  # a repeated batch
    assert sorted(map(tuple, E.current(spark, path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
