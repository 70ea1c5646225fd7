import pytest
from pyspark.sql import functions as F

from lodestack.llm import store


def test_numbers_and_sums_follow_the_order(spark):
    rows = [(None, 5)] + [(7, i) for i in range(500)] + [(i, None) for i in range(20)] + [(100, 3), (100, 3)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = store.numbered(df, "k", "v", sums=("v",), row="place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(len(rows)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)
    assert [(r.k, r.v) for r in got] == sorted(rows, key=key)
    total = 0
    for r in got:
        assert r.before_v == total
        total += r.v or 0
    assert store.numbered(df.limit(0), "k").collect() == []


def test_written_rows_stay_and_can_be_dropped(spark):
    df = store.written(spark.range(50).withColumn("r", F.rand()), "t")
    assert sorted(df.collect()) == sorted(df.collect()) and df.count() == 50
    made, others = store._MADE[spark.sparkContext.applicationId], store._MADE.setdefault("another application", ["somewhere/else"])
    made[:] = made[-1:]
    assert store.drop_tables(spark) == 1 and made == [] and others == ["somewhere/else"]
    with pytest.raises(Exception):
        df.collect()


def test_columns_are_found_or_refused(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert store.without(df, "B", "c").columns == ["a"]
    store.require(df, "a", "b")
    with pytest.raises(ValueError):
        store.require(df, "c")
    with pytest.raises(ValueError):
        store.require(df.select("a", F.col("b").alias("A")), "a")
