"""Query op4_personal: personal data in all documents, and the terms that disclose it."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.llm.personal import KINDS, TERM, personal_data
from lodestack.session import table

NAME, SQL = "op4_personal", None


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def run(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), t["end"].alias("end")))
    every = F.array_sort(F.concat("base", terms))
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def _is(k: int):
    return lambda s: s["kind"] == k
