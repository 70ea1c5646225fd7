"""Stores kept by a log of changes, against making everything anew."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators.ingestion import greedy_chunks
from lodestack.plans import preparation
from lodestack.streaming import changes as L

CHANGE = "doc long, operation string, text string, step int"


def stores(spark, path):
    upper = lambda d: d.select("doc", F.upper("text").alias("big"))
    words = lambda d: d.select("doc", F.explode(F.split("text", " ")).alias("word"))
    return L.Stores(spark, str(path / "stores"), {"upper": upper, "words": words})


def held(store):
    texts = {r.doc: r.text for r in store.read("documents").collect()}
    assert {r.doc: r.big for r in store.read("upper").collect()} == {d: t and t.upper() for d, t in texts.items()}
    assert sorted((r.doc, r.word) for r in store.read("words").collect()) == sorted((d, w) for d, t in texts.items() if t is not None for w in t.split(" "))
    return texts


def test_random_logs(spark, tmp_path):
    rng, want = random.Random(5), {d: f"first {d}" for d in range(6)}
    store, log = stores(spark, tmp_path), L.ChangeLog(spark, str(tmp_path / "log"))
    assert held(store) == {}
    assert store.bootstrap(spark.createDataFrame(list(want.items()), "doc long, text string")) == 6
    assert store.bootstrap(spark.createDataFrame([(99, "late")], "doc long, text string")) == 0, "stores that have documents stay as they are"
    for batch in range(3):
        steps = []
        for step in range(25):
            doc, operation = rng.randrange(10), rng.choice(L.OPERATIONS)
            text = rng.choice([f"b{batch} s{step}", "", None])
            steps.append((doc, operation, text, step))
            if operation == "uploaded":
                want[doc] = text
            elif operation == "deleted":
                want.pop(doc, None)
        log.append(spark.createDataFrame(steps, CHANGE), batch, "step")
        store.keep(log, files=1 if batch == 1 else None)
        assert held(store) == want, batch
    segments = store.spark.read.parquet(f"{store.path}/changed").select("segment").distinct().count()
    assert held(store.keep(log)) == want and store.spark.read.parquet(f"{store.path}/changed").select("segment").distinct().count() == segments, "nothing new, nothing done"
    store.apply(log.read(), 999)
    assert held(store) == want, "a change counts once"


def test_late_changes_do_not_undo_newer_ones(spark, tmp_path):
    store = stores(spark, tmp_path)
    schema = "seq long, doc long, operation string, text string"
    store.apply(spark.createDataFrame([(1, 1, "uploaded", "one"), (9, 2, "deleted", None)], schema), 0)
    store.apply(spark.createDataFrame([(7, 1, "reindexed", None), (5, 2, "uploaded", "gone"), (6, 3, "reindexed", None)], schema), 1)
    assert held(store) == {1: "one"}
    store.apply(spark.createDataFrame([(4, 1, "uploaded", "two")], schema), 2)
    assert held(store) == {1: "two"}


def test_failed_batches_do_not_count(spark, tmp_path):
    store = stores(spark, tmp_path)
    store.apply(spark.createDataFrame([(1, 1, "uploaded", "one")], "seq long, doc long, operation string, text string"), 0)
    spark.createDataFrame([(1, "half")], "doc long, text string").write.parquet(f"{store.path}/documents/segment={1:012d}")
    assert held(store) == {1: "one"}


def test_unknown_operations_are_errors(spark, tmp_path):
    log = L.ChangeLog(spark, str(tmp_path / "log"))
    with pytest.raises(Exception, match="no such operation"):
        log.append(spark.createDataFrame([(1, "moved", "x", 0)], CHANGE), 0)


def test_replayed_chunks(spark, sf_dir):
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        d = r.doc_id
        if d % 35 == 0 or (d % 11 and (d % 7 == 0 or d % 5)):
            text = r.text if d % 35 == 0 or d % 7 else "Another beginning. " + (r.text or "")
            want |= {(d, i, c) for i, c in enumerate(greedy_chunks(text))}
    assert {(r.doc, r.chunk, r.content) for r in preparation.replayed_chunks(spark, sf_dir).collect()} == want
