"""The corpus pipeline: five stages from raw documents to balanced shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder and
reads it again as the next stage's documents, so a lost executor repeats one stage at most. What the stages do with nulls, empty
and long texts, repeated rows and empty tables stands in lodestack/llm/pipeline.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm.pipeline import decontamination, mixing, near_duplicates, quality, sharding
from lodestack.llm.store import written
from lodestack.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The classifier is learnt, which SQL cannot express; the tests hold each stage against brute force.
ORACLE_SQL = None

STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
