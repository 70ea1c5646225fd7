import zlib

import pytest
from pyspark.sql import functions as F

from lodestack.llm import op5_sharding
from lodestack.llm.sharding import shard_by_bytes, shard_of


def brute(sizes, n):
    total, before, out = sum(sizes), 0, []
    for s in sizes:
        out.append((2 * before + s) * n // (2 * total))
        before += s
    return out


def test_query_agrees_with_brute_force(spark, sf_dir):
    rows = op5_sharding.run(spark, sf_dir).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    assert [r.size for r in rows] == [len(d.text.encode()) + 16 for d in docs]
    assert [r.text_crc32 for r in rows] == [zlib.crc32(d.text.encode()) for d in docs]
    shards = brute([r.size for r in rows], 40)
    assert [r.shard for r in rows] == shards
    slots = {}
    for r in rows:
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1


def test_odd_rows(spark):
    rows = [(None, "n", 1), (3, None, 2), (3, "", 3), (3, "same", 4), (3, "same", 4), (1, "é" * 50, 5), (2, "x" * 5000, 6)] + [(9, "hot", 7)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shard_by_bytes(docs, 4).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "size", "text_crc32", "shard", "slot"}
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    ids = [r.doc_id if r.doc_id is not None else -9 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert ids == sorted(ids)
    sizes = [r.size for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sorted(r.shard for r in got) == brute(sizes, 4)


def test_hot_id_is_split_evenly(spark):
    docs = spark.range(4000).selectExpr("if(id % 3 > 0, 7, id) AS doc_id", "'abcd' AS text")
    counts = [r["count"] for r in shard_by_bytes(docs, 8).groupBy("shard").count().collect()]
    assert counts == [500] * 8


def test_empty_table_and_bad_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shard_by_bytes(empty, 4).collect() == []
    with pytest.raises(ValueError):
        shard_by_bytes(empty, 0)
    with pytest.raises(ValueError):
        shard_by_bytes(empty.drop("text"), 2)


@pytest.mark.parametrize("loss", ["true", "false"])
def test_last_rows_of_large_tables_stay_in_the_last_shard(spark, loss):
    spark.conf.set("spark.sql.decimalOperations.allowPrecisionLoss", loss)
    try:
        for total in (10**9, 3 * 10**10, 10**14, 10**17):
            for size in (17, 500):
                middle = 2 * (total - size) + size
                row = spark.range(1).select(shard_of(F.lit(middle), total, 40).alias("last"), shard_of(F.lit(size), total, 40).alias("first"), shard_of(F.lit(middle), total, 10**6).alias("many")).first()
                assert tuple(row) == (39, 0, middle * 10**6 // (2 * total)) and row.many == 10**6 - 1
    finally:
        spark.conf.unset("spark.sql.decimalOperations.allowPrecisionLoss")
