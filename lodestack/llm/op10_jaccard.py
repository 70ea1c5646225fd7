"""Query op10_jaccard: components of documents that share 85 % of their four-word shingles."""

from lodestack.llm.jaccard import similar_documents
from lodestack.session import table

NAME = "op10_jaccard"

#: Every pair that shares a shingle, and the smallest document within reach, by recursion.
SQL = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' ')) END) AS s FROM listed
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT l.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(l.doc_id, (SELECT min(b) FROM reach WHERE a = l.doc_id)) AS component_id
FROM listed l LEFT JOIN sizes s ON s.doc_id = l.doc_id
"""


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_documents(docs).select("doc_id", "n_shingles", "component_id")
