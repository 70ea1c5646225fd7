"""Intermediate tables in the folder that all executors share, and prefix sums over an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Prefix of helper columns, so that no input column can clash with them.
OWN = "_ls_"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir. Where that is unset: a new folder of this machine, if the master is local; else an error,
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


#: What each application has put into the shared folder.
_MADE: dict[str, list[str]] = {}


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/lodestack/{what}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_tables(spark: SparkSession) -> int:
    """Delete all intermediate tables and files of this application, once no result that reads them is needed; how many there were."""
    jvm, n = spark.sparkContext._jvm, 0
    made = _MADE.get(spark.sparkContext.applicationId, [])
    while made:
        path = jvm.org.apache.hadoop.fs.Path(made.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, fixes row values."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def require(df: DataFrame, *names: str) -> None:
    """Fail early and clearly where a needed column is missing or its name occurs twice."""
    for name in names:
        if (n := sum(c.lower() == name.lower() for c in df.columns)) != 1:
            raise ValueError(f"column {name!r} occurs {n} times in {df.columns}; it must occur once")


def in_order(df: DataFrame, *order, partitions: int | None = None) -> DataFrame:
    """df range-partitioned and sorted by order; rows equal in order may lie in several partitions."""
    tie = f"{OWN}tie"
    keyed = df.withColumn(tie, F.monotonically_increasing_id())
    n = partitions or shuffle_partitions(df.sparkSession)
    return keyed.repartitionByRange(n, *order, F.col(tie)).sortWithinPartitions(*order, F.col(tie)).drop(tie)


def numbered(df: DataFrame, *order, sums: tuple[str, ...] = (), row: str = "row", what: str = "numbered") -> DataFrame:
    """df with its place in the order (row, from 0) and, for each column in sums, before_<column>: the sum over all rows before.

    Built-in operations only, and no task sees more than a range partition: each numbers its own rows, and the
    partitions' totals (one row each) give every partition its start. Null counts as 0 in sums.
    """
    part = f"{OWN}part"
    spark = df.sparkSession
    placed = written(in_order(df, *order).withColumns({part: F.spark_partition_id(), f"{OWN}at": F.monotonically_increasing_id()}), what)
    totals = placed.groupBy(part).agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(c) for c in sums]).orderBy(part).collect()
    starts, n, running = [], 0, [0] * len(sums)
    for t in totals:
        starts.append((t[part], n, *running))
        n, running = n + t["n"], [a + (t[c] or 0) for a, c in zip(running, sums, strict=True)]
    schema = ", ".join([f"{part} int, {OWN}n long", *[f"{OWN}s{i} long" for i in range(len(sums))]])
    offsets = F.broadcast(spark.createDataFrame(starts, schema))
    here = Window.partitionBy(part).orderBy(f"{OWN}at")
    local = {row: F.row_number().over(here) - 1 + F.col(f"{OWN}n")}
    for i, c in enumerate(sums):
        local[f"before_{c}"] = F.coalesce(F.sum(c).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col(f"{OWN}s{i}")
    return placed.join(offsets, part).withColumns(local).select(*df.columns, *local)
