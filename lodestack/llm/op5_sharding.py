"""Query op5_sharding: all documents in 40 contiguous shards of nearly equal bytes."""

from pyspark.sql import functions as F

from lodestack.llm.sharding import shard_by_bytes
from lodestack.session import table

NAME = "op5_sharding"

#: In the order of doc_id (unique in this table), sizes are summed and cut at equal targets.
SQL = """
WITH steps AS (
  SELECT list(x ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS x FROM range(256) r(i)
  )
), sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, (
    SELECT xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) FROM steps
  ) AS text_crc32 FROM documents
), summed AS (
  SELECT doc_id, size, text_crc32, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized
), cut AS (
  SELECT doc_id, size, text_crc32, CAST((2 * before + size) * 40 // (2 * total) AS INTEGER) AS shard FROM summed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shard_by_bytes(docs, 40, keep_text=False)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
