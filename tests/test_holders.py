"""Which documents have all words of a query, without pairs as rows."""

import random

from test_likesets import shuffled

from lodestack.operators import blocks as B
from lodestack.plans import passages


def test_holders_are_those_of_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    docs = {i: [rng.choice("abcdefghij") for _ in range(rng.randrange(12))] for i in range(-40, 120)}
    table = spark.createDataFrame([*docs.items(), (500, None)], "doc long, words array<string>").repartition(3)
    asked = {i: rng.sample("abcdefghijz", rng.randrange(5)) for i in range(30)} | {7: ["a", "a", "b"], 999: ["a"]}
    monkeypatch.setattr(B, "SHARD", 25)
    monkeypatch.setattr(B, "ASKED_ROWS", 20)  # several passes
    monkeypatch.setattr(B, "HOLD_BYTES", 9)
    index = B.block_index(table, "doc", "words")
    got = {r["query"]: (r.found, r.n) for r in B.holders(index, spark.createDataFrame(list(asked.items()), "q int, w array<string>"), "q", "w").collect()}
    want = {q: (set(w) <= set(docs.get(q, ())), sum(set(w) <= set(d) for d in docs.values())) for q, w in asked.items() if w}
    assert got == want and len({found for found, _ in want.values()}) == 2


def test_documents_that_find_each_other_are_not_pairs(spark, tmp_path):
    """Each query went on with every document that has its rarest word."""
    docs = [(i, f"one two three four five six seven eight {i % 3} more") for i in range(4000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = shuffled(spark)
    got = passages.self_retrieval(spark, str(tmp_path)).collect()
    print("bytes shuffled", shuffled(spark) - before)
    assert len(got) == 80 and {(r.found, r.n_equal) for r in got} == {(True, 4000)}
    assert shuffled(spark) - before < 400_000
