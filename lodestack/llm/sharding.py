"""Contiguous shards of nearly equal size, cut from a global prefix sum of byte sizes.

Law ``bytes``: rows are ordered by id (nulls first; equal ids in any fixed order). Each range partition
sums its own rows; the sums of the partitions (one row each) give every partition its start, and a row
goes to the shard that holds the middle of its bytes. A shard is then off its equal target by less than
the size of the two rows at its ends.

An empty table gives no rows; a null or empty text still has the fixed overhead as its size, so it has a place.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm import memory
from lodestack.llm.store import OWN, in_order, require, without, written

OVERHEAD = 16


def _local_sums(size_at: int):
    """Adds to each row its partition, its place in it and the bytes before it there."""

    def run(batches):
        part, rows, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            ends = batch.column(size_at).to_numpy(zero_copy_only=False).cumsum() + before
            starts = ends - batch.column(size_at).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(rows, rows + n), pa.int64()), pa.array(starts, pa.int64())],
                names=[*batch.schema.names, f"{OWN}part", f"{OWN}row", f"{OWN}before"],
            )
            if n:
                rows, before = rows + n, int(ends[-1])

    return run


def shard_of(middle: Column, total: int, n_shards: int) -> Column:
    """The shard of a row from twice the place of its middle byte (a long) and the bytes of all rows.

    Whole numbers of any size: `div` leaves out the fraction, where a quotient of decimals would be rounded up to n_shards near the end.
    """
    return F.call_function("div", middle.cast("decimal(38,0)") * F.lit(n_shards).cast("decimal(10,0)"), F.lit(max(1, 2 * total)).cast("decimal(38,0)")).cast("int")


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD, keep_text: bool = True, order: tuple[Column, ...] | None = None) -> DataFrame:
    """docs with size, text_crc32, shard (0 to n_shards - 1) and slot (gapless from 0 in a shard).

    size: UTF-8 bytes of the text (null: none) plus overhead, which must be positive. text_crc32: of the
    UTF-8 bytes (null: of none). Columns of docs with these four names are replaced. keep_text=False leaves
    the text out, so that only ids and sizes are shuffled. Only one row per partition is gathered. Shards are cut from
    the order of ids, or from another one given by columns.
    """
    if n_shards < 1 or overhead < 1:
        raise ValueError("n_shards and overhead must be at least 1")
    require(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = without(docs, "size", "text_crc32", "shard", "slot").withColumns({"size": (F.octet_length(text) + F.lit(overhead)).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
    sized = sized if keep_text else sized.drop(text_col)
    schema = T.StructType([*sized.schema.fields, T.StructField(f"{OWN}part", T.IntegerType()), T.StructField(f"{OWN}row", T.LongType()), T.StructField(f"{OWN}before", T.LongType())])
    placed = written(in_order(sized, *(order or (F.col(id_col),))).mapInArrow(memory.batches(_local_sums(sized.columns.index("size"))), schema), "sharding")

    sums = placed.groupBy(f"{OWN}part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).orderBy(f"{OWN}part").collect()
    starts, rows, total = [], 0, 0
    for part, n, b in sums:
        starts.append((part, rows, total))
        rows, total = rows + n, total + b
    spark = docs.sparkSession
    offsets = spark.createDataFrame(starts, f"{OWN}part int, {OWN}row0 long, {OWN}byte0 long")
    middle = 2 * (F.col(f"{OWN}before") + F.col(f"{OWN}byte0")) + F.col("size")
    at = placed.join(F.broadcast(offsets), f"{OWN}part").withColumns(
        {
            "shard": shard_of(middle, total, n_shards),
            f"{OWN}row": F.col(f"{OWN}row") + F.col(f"{OWN}row0"),
        }
    )
    firsts = F.broadcast(at.groupBy("shard").agg(F.min(f"{OWN}row").alias(f"{OWN}first")))
    return at.join(firsts, "shard").withColumn("slot", F.col(f"{OWN}row") - F.col(f"{OWN}first")).select(*sized.columns, "shard", "slot")
