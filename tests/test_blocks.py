"""BM25 over blocks, against plain loops; what it skips on the given tables."""

import pytest
from pyspark.sql import functions as F

from lodestack.operators import blocks as B
from lodestack.plans import retrieval
from tests.test_retrieval import brute, corpus


@pytest.mark.parametrize(("shard", "block", "first", "rows"), [(8192, 32, 8, 200_000), (25, 4, 1, 200_000), (7, 2, 1, 5)])
def test_agrees_with_plain_loops(spark, monkeypatch, shard, block, first, rows):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("FIRST_BLOCKS", first), ("ASKED_ROWS", rows)):
        monkeypatch.setattr(B, name, value)
    docs, queries = corpus()
    index = B.block_index(spark.createDataFrame(docs, "doc_id long, words array<string>"), "doc_id", "words")
    asked = spark.createDataFrame(queries, "item_id long, words array<string>")
    for k in (3, 10, 200):
        got = [(r["query"], r.doc, r.score, r["rank"]) for r in B.bm25_search(index, asked, "item_id", "words", k).collect()]
        assert sorted(got) == sorted(brute(docs, queries, k))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, []), (3, ["a", "a", ""]), (4, ["a"])], "id long, words array<string>")
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, [""])], "q long, words array<string>")
    got = B.bm25_search(B.block_index(docs, "id", "words"), asked, "q", "words", 5).collect()
    assert sorted(r.doc for r in got) == [3, 4] and {r["query"] for r in got} == {1}
    assert B.bm25_search(B.block_index(docs.limit(0), "id", "words"), asked, "q", "words", 5).collect() == []
    assert B.bm25_search(B.block_index(docs, "id", "words"), asked.limit(0), "q", "words", 5).collect() == []


def test_allowed_documents_are_fetched_until_there_are_enough(spark):
    docs, queries = corpus()
    index = B.block_index(spark.createDataFrame(docs, "doc_id long, words array<string>"), "doc_id", "words")
    asked = spark.createDataFrame(queries, "item_id long, words array<string>")
    allowed = spark.range(0, 120).where("id % 23 = 1").select(F.col("id").alias("doc"))
    want = []
    for q in queries:
        fit = [r for r in brute(docs, [q], 1000) if r[1] % 23 == 1][:3]
        want += [(*r, i + 1) for i, r in enumerate(fit)]
    got = B.bm25_search_allowed(index, asked, "item_id", "words", allowed, 3, more=2).collect()
    assert sorted((r["query"], r.doc, r.score, r["rank"], r.place) for r in got) == sorted(want)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_over_half_of_the_blocks_are_skipped(spark, sf):
    index, asked = retrieval.blocks(spark, sf), retrieval.asked(spark, sf)
    blocks, scored = B.bm25_search(index, asked, "item_id", "words", 10, counted=True).agg(F.sum("blocks"), F.sum("scored")).first()
    print(f"{sf}: {scored} of {blocks} blocks scored")
    assert scored < blocks / 2
