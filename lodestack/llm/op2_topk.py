"""Query op2_topk: the 5 best integer inner products of every vector whose id is divisible by 50, over all vectors."""

from pyspark.sql import functions as F

from lodestack.llm.topk import quantised, top_k, usable
from lodestack.session import table

NAME = "op2_topk"

SQL = """
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def run(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where(usable(F.col("embedding")))
    return top_k(vectors.withColumn("embedding", quantised(F.col("embedding"))), F.col("vec_id") % 50 == 0, 5)
