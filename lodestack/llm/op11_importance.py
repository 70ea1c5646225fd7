"""Query op11_importance: documents drawn by their likeness to the benchmark."""

from lodestack.llm.importance import importance_resample
from lodestack.session import table

NAME = "op11_importance"

SQL = r"""
WITH steps AS (
  SELECT list(x ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS x FROM range(256) r(i)
  )
), held AS (
  SELECT true AS own, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT false, item_id, coalesce(text, '') FROM benchmark
), cut AS (
  SELECT own, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM held
), runs AS (
  SELECT own, doc_id, array_to_string(w[i + 1:i + n], ' ') AS feature FROM (SELECT own, doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM cut, range(1, 4) r(n) WHERE len(w) >= n)
), features AS (
  SELECT own, doc_id, feature, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) % 10000 AS bucket FROM (SELECT DISTINCT feature FROM features), steps
), counts AS (
  SELECT bucket, sum(n) FILTER (own) AS s, sum(n) FILTER (NOT own) AS t FROM features JOIN hashed USING (feature) GROUP BY 1
), totals AS (
  SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts, totals
), weights AS (
  SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS n FROM features JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE own GROUP BY 1
), scored AS (
  SELECT c.doc_id, len(w) >= 20 AS eligible, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || CAST(c.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM cut c LEFT JOIN weights x ON c.doc_id = x.doc_id WHERE c.own
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place, count(*) FILTER (eligible) OVER () * 5 // 100 AS n_drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= n_drawn THEN place END AS rank FROM ranked
"""


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = importance_resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
