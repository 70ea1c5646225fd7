"""Files with like names, of which one name has many copies."""

from lodestack.plans import enrichment


def test_copies_are_spread_out_by_blocks(spark, tmp_path, monkeypatch):
    """All pairs of the copies of a name came from one task."""
    docs = [(i, "alpha beta gamma delta epsilon", f"src{i % 2}") for i in range(90)] + [(i, "alpha beta gamma delta omega", "src1") for i in range(90, 100)] + [(200, "nothing like that here", None), (201, None, "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(enrichment, "COPIES", 15, raising=False)
    df = enrichment.filename_duplicates(spark, str(tmp_path))
    tasks = [n for n in df.rdd.glom().map(len).collect() if n]
    want = {(a, b): 0.99 for a in range(90) for b in range(a + 1, 90)} | {(a, b): 0.99 for a in range(90, 100) for b in range(a + 1, 100)}
    want |= {(a, b): round(4 / 6 + 0.15, 3) for a in range(1, 90, 2) for b in range(90, 100)}
    got = {(r.a, r.b): r.score for r in df.collect()}
    assert got == want and df.count() == len(want)
    assert max(tasks) < 0.6 * sum(tasks), tasks
