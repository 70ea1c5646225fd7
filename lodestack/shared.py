"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where that is unset: a new folder of this machine, if the master is local; else an error,
    as other machines could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestack-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lodestack/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and has a known size."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; df should be a table, as it is counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def sign_of_files(df: DataFrame) -> tuple | None:
    """A sign of the files that df is read from (number, and a sum over names, sizes and times); None where it is not read from files."""
    try:
        files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    except Exception as unknown:  # noqa: BLE001
        if type(unknown).__name__ != "AnalysisException":
            raise
        return None
    return tuple(files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first())


def numbered(df: DataFrame, *order, row: str = "row") -> DataFrame:
    """df as a table with the place of each row (from 0) in an order over the whole, which should be of unique keys.

    Rows are range-partitioned and sorted; each partition numbers its own, and the partitions' counts (a row each) give its start.
    """
    spark, part, at = df.sparkSession, "_part", "_at"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()})
    placed = written(placed, "numbered")
    starts, total = [], 0
    for p, rows in placed.groupBy(part).agg(F.count("*")).orderBy(part).collect():
        starts.append((p, total))
        total += rows
    offsets = F.broadcast(spark.createDataFrame(starts, f"{part} int, _start long"))  # a row a partition
    own = F.row_number().over(Window.partitionBy(part).orderBy(at)) - 1
    return placed.withColumn(row, own).join(offsets, part).withColumn(row, F.col(row) + F.col("_start")).drop(part, at, "_start")


def with_neighbours(df: DataFrame, keys: list[str], order: list, what: str) -> DataFrame:
    """df with its place in its group (place, from 1), and what of the row before and after it there (before, after); a group may be of any size.

    keys and order together should be unique. Neighbours meet by their number in the whole, not in a task of their group.
    """
    whole = written(numbered(df, *keys, *order), "neighbours")
    same = F.struct(*keys) if keys else F.lit(0)
    slim = whole.select("row", same.alias("_group"), F.col(what).alias("_what"))
    first = slim.groupBy("_group").agg(F.min("row").alias("_first"))
    side = lambda step, name: slim.select((F.col("row") + step).alias("row"), F.col("_group").alias(f"_of_{name}"), F.col("_what").alias(name))
    out = whole.withColumn("_group", same).join(first, "_group").join(side(1, "before"), "row", "left").join(side(-1, "after"), "row", "left")
    near = lambda name: F.when(F.col(f"_of_{name}") == F.col("_group"), F.col(name)).alias(name)
    return out.select(*df.columns, (F.col("row") - F.col("_first") + 1).alias("place"), near("before"), near("after"))
