"""A log of changes to documents, read as a stream, that keeps stores of what is derived from them: only changed documents are made anew, each change counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from lodestack.shared import numbered, small, written

#: What a change may be: a document is new or replaced, is to be made anew from the text it has, or goes.
OPERATIONS = ("uploaded", "reindexed", "deleted")
#: Tables of changed documents of at most so many rows are broadcast; the count is checked.
BROADCAST_ROWS = 300_000


class ChangeLog:
    """An append-only table of changes (seq, doc, operation, text) in a folder, in batches that Spark's committer makes whole or absent.

    Batches are numbered by the caller, from 0 and without gaps; seq is the batch's number and the place in it, so it grows along the log. A batch appended again (after
    a failure) takes the place of its first writing and has the same numbers.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint"):
        self.spark, self.path = spark, path
        self.schema = StructType.fromDDL(f"seq bigint, doc {key_type}, operation string, text string")

    def append(self, changes: DataFrame, batch: int, *order: str) -> ChangeLog:
        """Add changes (doc, operation, text and the columns they are ordered by). Operations that are none of OPERATIONS are an error."""
        own = changes.withColumn("operation", F.when(F.col("operation").isin(*OPERATIONS), F.col("operation")).otherwise(F.raise_error(F.concat(F.lit("no such operation: "), F.coalesce("operation", F.lit("null"))))))
        placed = numbered(own, *(order or ("doc",)), row="_row").withColumn("seq", F.lit(batch).cast("bigint") * 2**40 + F.col("_row"))
        placed.select("seq", F.col("doc").cast(self.schema["doc"].dataType).alias("doc"), "operation", "text").write.mode("overwrite").parquet(f"{self.path}/batch-{batch:012d}")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("pathGlobFilter", "*.parquet").parquet(f"{self.path}/batch-*")

    def stream(self, files: int | None = None) -> DataFrame:
        """The log as a stream; files at most a time."""
        reader = self.spark.readStream.schema(self.schema).option("pathGlobFilter", "*.parquet")
        return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{self.path}/batch-*")


def newest(changes: DataFrame) -> DataFrame:
    """(doc, seq, operation, text): the last change of each document that says what it is; a request to make it anew says nothing of the text, so it counts only where it is alone."""
    says = F.when(F.col("operation") != "reindexed", F.col("seq"))
    per = changes.groupBy("doc").agg(F.max_by(F.struct("seq", "operation", "text"), says).alias("_last"))
    return per.select("doc", "_last.seq", F.coalesce("_last.operation", F.lit("reindexed")).alias("operation"), "_last.text")


class Stores:
    """Tables derived from documents, as segments on storage.

    derived: for each store a function from documents (doc, text) to its rows, which must have the column doc. A batch of changes writes for each store a segment with the rows
    of the documents that it changes, and one table of which documents these are; a reader takes a document's rows from the segment of its newest text. A batch that
    runs again writes the same segment again, so a change counts once. The texts themselves are the store documents.
    """

    def __init__(self, spark: SparkSession, path: str, derived: dict[str, Callable[[DataFrame], DataFrame]], key_type: str = "bigint"):
        if "documents" in derived:
            raise ValueError("documents is the store of the texts")
        self.spark, self.path, self.derived = spark, path, derived
        self.key = f"doc {key_type}"
        empty = spark.createDataFrame([], f"{self.key}, text string")
        self.schemas = {"documents": empty.schema, **{name: make(empty).schema for name, make in derived.items()}}

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Take in a batch of changes; the foreachBatch function of keep(). A document made anew keeps the seq of its text, so changes may come in any order."""
        place, last = f"segment={batch:012d}", newest(changes)
        held = self._held("documents", batch).join(last.where("operation = 'reindexed'").select("doc"), "doc", "left_semi").select("doc", "seq", "text")
        path = f"{self.path}/documents/{place}"
        last.where("operation = 'uploaded'").select("doc", "seq", "text").unionByName(held).write.mode("overwrite").parquet(path)
        docs = self.spark.read.schema(f"{self.key}, seq bigint, text string").parquet(path)
        for name, make in self.derived.items():
            make(docs.select("doc", "text")).write.mode("overwrite").parquet(f"{self.path}/{name}/{place}")
        touched = docs.select("doc", "seq").unionByName(last.where("operation = 'deleted'").select("doc", "seq"))
        touched.write.mode("overwrite").parquet(f"{self.path}/changed/{place}")

    def keep(self, log: ChangeLog, files: int | None = None) -> Stores:
        """Take in what the log has got since the last call; where the stream stands is kept beside the stores."""
        run = log.stream(files).writeStream.foreachBatch(self.apply)
        run.option("checkpointLocation", f"{self.path}/_stream").trigger(availableNow=True).start().awaitTermination()
        return self

    def read(self, name: str) -> DataFrame:
        """A store as it is now. Segments without their table of changed documents are of a batch that failed, and don't count."""
        return self._held(name).select(*self.schemas[name].names)

    def _held(self, name: str, before: int | None = None) -> DataFrame:
        """A store's rows with seq, as it is now or was before a batch."""
        schema = self.schemas[name]
        if not self._exists("changed"):
            return self.spark.createDataFrame([], StructType([*schema.fields]).add("seq", LongType()))
        read = lambda n, columns: self.spark.read.option("basePath", f"{self.path}/{n}").schema(columns).parquet(f"{self.path}/{n}")
        changed, rows = read("changed", f"{self.key}, seq bigint, segment bigint"), read(name, StructType([*schema.fields]).add("segment", LongType()))
        if before is not None:
            changed, rows = changed.where(F.col("segment") < before), rows.where(F.col("segment") < before)
        newest_of = changed.groupBy("doc").agg(F.max(F.struct("seq", "segment")).alias("_n")).select("doc", "_n.seq", "_n.segment")
        return rows.join(small(written(newest_of, "newest-segments"), BROADCAST_ROWS), ["doc", "segment"]).drop("segment")

    def bootstrap(self, docs: DataFrame) -> int:
        """Fill empty stores from a table of documents (doc, text), before all changes; stores that have any stay as they are. Gives the number of documents taken in."""
        if self._exists("changed"):
            return 0
        self.apply(docs.select(F.lit(-1).cast("bigint").alias("seq"), "doc", F.lit("uploaded").alias("operation"), "text"), -1)
        return self.read("documents").count()

    def _exists(self, name: str) -> bool:
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)
