"""Query op9_warc: all pages written as web archives and read back."""

from pyspark.sql import functions as F

from lodestack.llm.store import new_path
from lodestack.llm.warc import decide, read_archives, write_archives
from lodestack.session import table

NAME = "op9_warc"

SQL = """
WITH held AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM held
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM firsts
"""


def run(spark, sf_dir):
    path = new_path(spark, "warc")
    write_archives(decide(table(spark, sf_dir, "pages")), path)
    page = lambda uri: F.regexp_extract(uri, r"^<urn:page:(-?\d+):", 1).try_cast("long")
    return read_archives(spark, path).select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))
