"""The stages of the corpus pipeline, from raw documents to balanced shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Nulls in any column, empty and very long texts, repeated rows and
rows without an id are taken as by the operator of the stage: a null text is an empty one, whole texts are read, and an empty table
gives no rows. Columns of docs besides those that a stage needs are kept as they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.jaccard import similar_documents
from lodestack.llm.mixing import mix
from lodestack.llm.quality import train, with_scores
from lodestack.llm.sharding import shard_by_bytes
from lodestack.llm.store import OWN, in_order, written
from lodestack.llm.winnowing import contamination
from lodestack.session import table

#: A document stays from this score on.
QUALITY = 0.7
#: Near copies share four fifths of their shingles of five words.
PERCENT, WIDTH = 80, 5
SHARDS = 40
#: Lists of keys (16 bytes each) up to this length are broadcast; the length is checked.
BROADCAST_ROWS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Without labels none is accepted, as all scores are then 0.5."""
    scored = with_scores(docs, train(docs, table(spark, sf_dir, "labels")), out=f"{OWN}score")
    return scored.where(F.col(f"{OWN}score") >= QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id (of rows that repeat it, one); documents without words all stay."""
    found = written(similar_documents(docs, PERCENT, WIDTH).where("n_shingles > 0"), "pipeline-components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first")
    # Rows without an id meet by the set that they share, all others by their component.
    group = [F.coalesce(F.col("component_id").cast("string"), "set_id").alias("group"), F.col("component_id").isNull().alias("nameless")]
    kept = found.select("*", *group).groupBy("group", "nameless").agg(first).select("first.doc_id", "first.text_hash")
    kept = written(kept.withColumn("stays", F.lit(True)), "pipeline-kept")
    keys = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    same = keys["doc_id"].eqNullSafe(kept["doc_id"]) & (keys["text_hash"] == kept["text_hash"])
    gone = written(keys.join(kept, same, "left").where("stays IS NULL").select(keys["doc_id"].alias("gone_id"), keys["text_hash"].alias("gone_hash")), "pipeline-gone")
    near = F.broadcast if gone.count() <= BROADCAST_ROWS else (lambda df: df)
    held = docs.withColumn(f"{OWN}hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = held.join(near(gone), held["doc_id"].eqNullSafe(gone["gone_id"]) & (held[f"{OWN}hash"] == gone["gone_hash"]), "left_anti")
    if not keys.where("n > 1").isEmpty():  # rows that repeat id and text
        wordless = out.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
        out = out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).dropDuplicates(["doc_id", f"{OWN}hash"]).unionByName(wordless)
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands; all, where the benchmark is empty."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (not at all, once or twice), in the order of the mix.

    Documents stay whole, so a source's target is met up to one document. A copy stands where the first piece of its pass does.
    The rows are range-partitioned and sorted by that order, which a table written from them keeps by file and place.
    """
    key = ["doc_id", "source", "text_crc32"]
    taken = written(mix(docs).select(*key, "spots"), "pipeline-taken")
    repeats = not taken.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    copies = taken.select(F.col("doc_id").alias(f"{OWN}id"), F.col("source").alias(f"{OWN}source"), "text_crc32", F.explode("spots").alias(f"{OWN}spot"))
    copies = written(copies, "pipeline-copies")  # a table, so that its true size decides how it is joined
    held = docs.withColumn(f"{OWN}crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    if repeats:  # the copies of rows that repeat a key are those of one of them
        held = held.dropDuplicates(["doc_id", "source", f"{OWN}crc"])
    same = held["doc_id"].eqNullSafe(copies[f"{OWN}id"]) & held["source"].eqNullSafe(copies[f"{OWN}source"]) & (held[f"{OWN}crc"] == copies["text_crc32"])
    mixed = held.join(copies, same).select(*[held[c] for c in docs.columns], f"{OWN}spot")
    return in_order(mixed, F.col(f"{OWN}spot")).select(*docs.columns)


def written_order(docs: DataFrame) -> tuple[DataFrame, tuple[Column, ...] | None]:
    """docs with the columns by which its rows stand as they were written (file by number, then row); None where it isn't read from files."""
    file, row = f"{OWN}file", f"{OWN}line"
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:  # not a table of Parquet files
        return docs, None
    return placed, (F.length(file), F.col(file), F.col(row))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their size, shard and slot. Shards are cut from the order of the mix, in which docs was written; from that
    of doc_id, where docs isn't read from files."""
    placed, order = written_order(docs)
    return shard_by_bytes(placed, SHARDS, order=order).select(*docs.columns, "size", "text_crc32", "shard", "slot")
