"""Quality scores for all documents by a classifier that learns from a bounded sample of labelled ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm import memory
from lodestack.llm.store import require, without
from lodestack.llm.subword import SubwordClassifier, slices

#: Most labelled documents to learn from. Their whole texts are taken apart in tasks; the driver gets their features, each at most
#: the classifier's buckets (8 bytes a feature: half a megabyte for the longest text).
TRAIN_ROWS = 1500
CHUNK_BYTES = 1_000_000


def held_out(doc_id: Column) -> Column:
    """The quarter of ids that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most rows labelled ids, drawn by a hash of the id; held-out ids, null ids and labels other
    than 0 and 1 never. Of several labels of an id, the largest counts."""
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64(F.lit("train"), F.col("id")), "id").limit(rows)  # a bounded table
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "id").select("id", "text", "label")


def _taken_apart(model: SubwordClassifier):
    def run(batches):
        for batch in batches:
            found = [model.document(t.as_py()) for t in batch.column("text")]
            features = [pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("label"), batch.column("hash"), *features], names=["draw", "label", "hash", "f", "share"])

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS, **columns) -> SubwordClassifier:
    """A classifier for label_col, learnt from whole texts of at most rows labelled rows. Without any usable label its scores are 0.5.

    A null text is an empty one. Rows that repeat a drawn id all may be drawn, up to the bound.
    """
    model = SubwordClassifier()
    sample = training_rows(docs, labels, label_col, rows, **columns).select(F.xxhash64(F.lit("train"), F.col("id")).alias("draw"), "label", F.xxhash64("text").alias("hash"), "text")
    taken = sample.mapInArrow(memory.batches(_taken_apart(model)), "draw long, label int, hash long, f array<int>, share array<float>")
    got = taken.orderBy("draw", "hash", "label").limit(rows).toArrow()
    if not got.num_rows:
        model.weights = np.zeros(model.buckets, np.float32)
        return model
    docs = [(f.values.to_numpy(), s.values.to_numpy()) for f, s in zip(got["f"], got["share"], strict=True)]
    return model.learn(docs, got["label"].to_numpy())


def with_scores(docs: DataFrame, model: SubwordClassifier, text_col: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with out: how likely class 1 is, by the whole text, however long (null as empty). A column of docs by that name is
    replaced; an empty table gives no rows."""
    require(docs, text_col)
    base = without(docs, out)
    at = base.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # buckets numbers, 256 KB

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            found = [held.value.scores(texts.slice(a, b - a)) for a, b in slices(texts, CHUNK_BYTES)]
            scores = pa.array(np.concatenate(found) if found else [], pa.float64())
            columns = [c for i, c in enumerate(batch.columns) if keep_text or i != at]
            names = [n for i, n in enumerate(batch.schema.names) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*columns, scores], names=[*names, out])

    fields = [f for i, f in enumerate(base.schema.fields) if keep_text or i != at]
    return base.mapInArrow(memory.batches(run), T.StructType([*fields, T.StructField(out, T.DoubleType())]))
