"""Query op1_tokens: all documents as token files, read back and digested."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.store import new_path, written
from lodestack.llm.tokens import read_token_files, write_token_files
from lodestack.session import table

NAME, SQL = "op1_tokens", None
END_ID = 2
#: Starts of so many files at most are sent to all tasks; the count is checked.
BROADCAST_FILES = 200_000


def run(spark, sf_dir, tokenizer: str | None = None):
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer, END_ID)
    read = written(read_token_files(spark, path), "tokens-read")
    # The ids of all partitions before (a row each), of the files before in the partition, and of the documents before in the file.
    files = written(read.groupBy("part", "number").agg(F.sum("n_tokens").alias("n")), "tokens-files")
    starts, total = {}, 0
    for part, n in files.groupBy("part").agg(F.sum("n")).orderBy("part").collect():
        starts[part] = total
        total += n
    # From Arrow, as lists of rows would go through Python workers.
    parts = F.broadcast(spark.createDataFrame(pa.table({"part": pa.array(starts.keys(), pa.int64()), "part_start": pa.array(starts.values(), pa.int64())})))
    earlier = F.sum("n").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    offsets = files.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(parts, "part").select("part", "number", (F.col("part_start") + F.col("earlier")).alias("file_start"))
    offsets = F.broadcast(offsets) if files.count() <= BROADCAST_FILES else offsets
    before = F.sum("n_tokens").over(Window.partitionBy("part", "number").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    out = read.withColumn("before", F.coalesce(before, F.lit(0))).join(offsets, ["part", "number"])
    return out.select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
