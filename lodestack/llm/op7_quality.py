"""Query op7_quality: a quality score for every document."""

from pyspark.sql import functions as F

from lodestack.llm.quality import held_out, train, with_scores
from lodestack.session import table

NAME, SQL = "op7_quality", None
THRESHOLD = 0.7


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = with_scores(docs, model, keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
