"""Query op8_mixing: all documents mixed to the weights 5, 2, 1, repeating, at 150 % of their words."""

from lodestack.llm.mixing import mix
from lodestack.session import table

NAME = "op8_mixing"

#: A source takes its stream, in shuffled order and at most twice, up to the whole words of its target, in blocks of 1024 words whose slots are
#: bit-reversed steps.
SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS size, CAST(2 * sum(size) AS DOUBLE) AS most,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source
), levels(n, level) AS (
  SELECT 0, 1.5::DOUBLE * sum(size) / sum(weight) FROM sources
  UNION ALL
  SELECT n + 1, (SELECT (1.5::DOUBLE * sum(size) - coalesce(sum(most) FILTER (most < weight * level), 0)) / sum(weight) FILTER (most >= weight * level) FROM sources)
  FROM levels WHERE n < 30
), due AS (
  SELECT source, size, least(most, weight * (SELECT level FROM levels WHERE n = 30)) AS target FROM sources
), blocked AS (
  SELECT source, size, target, CAST(floor(target) AS BIGINT) AS due, CAST(ceil(floor(target) / 1024) AS BIGINT) AS blocks,
    CAST(sum(ceil(floor(target) / 1024)) OVER (ORDER BY source NULLS FIRST ROWS UNBOUNDED PRECEDING) - ceil(floor(target) / 1024) AS BIGINT) AS before,
    CAST(sum(ceil(floor(target) / 1024)) OVER () AS BIGINT) AS total
  FROM due
), steps AS (
  SELECT source, before + unnest(range(blocks)) AS step, CASE WHEN total <= 2 THEN 1 ELSE length(bin(total - 1)) END AS bits FROM blocked
), reversed AS (
  SELECT source, CAST(list_sum(list_transform(range(bits), lambda i: ((step >> i) & 1) << (bits - 1 - i))) AS BIGINT) AS slot FROM steps
), slots AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS block FROM reversed
), stream AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, doc_id, source, size,
    CAST(sum(size) OVER (PARTITION BY source ORDER BY md5('mix|' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS fore
  FROM sized
), passes AS (
  SELECT rn, s.source, fore + p * CAST(b.size AS BIGINT) AS start, least(fore + p * CAST(b.size AS BIGINT) + s.size, due) AS stop
  FROM stream s JOIN blocked b ON s.source IS NOT DISTINCT FROM b.source, (SELECT unnest([0, 1]) AS p)
), pieces AS (
  SELECT rn, source, start, stop, unnest(range(start // 1024, (stop - 1) // 1024 + 1)) AS block FROM passes WHERE stop > start
), found AS (
  SELECT rn, CAST(sum(least(stop, (p.block + 1) * 1024) - greatest(start, p.block * 1024)) AS BIGINT) AS taken, count(*) AS n_pieces, min(slot) AS first_slot
  FROM pieces p JOIN slots t ON p.source IS NOT DISTINCT FROM t.source AND p.block = t.block GROUP BY rn
)
SELECT doc_id, CAST(s.size AS BIGINT) AS size, CAST(b.size AS BIGINT) AS source_size, target, coalesce(taken, 0) AS taken, coalesce(n_pieces, 0) AS n_pieces, first_slot
FROM stream s JOIN blocked b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN found USING (rn)
"""


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "first_slot")
