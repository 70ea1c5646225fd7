import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import op2_topk, topk
from lodestack.llm.balltree import BallTree, TopK, exact_scores
from lodestack.llm.topk import quantised, top_k, usable


def brute(rows, k=5, every=50):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for own, (q, a) in enumerate(ok):
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for other, (i, b) in enumerate(ok) if other != own and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def asked(docs, every=50, **more):
    docs = docs.where(usable(F.col("embedding"))).withColumn("embedding", quantised(F.col("embedding")))
    return sorted(map(tuple, top_k(docs, F.col("vec_id") % every == 0, **more).collect()))


def test_query_agrees_with_sql_and_brute_force(spark, sf_dir):
    got = sorted(map(tuple, op2_topk.run(spark, sf_dir).collect()))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert got == sorted(c.sql(op2_topk.SQL).fetchall())
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()])


def test_odd_rows_and_ties(spark):
    hot = [0.5, -0.25, 0.125]
    rows = [(i, hot) for i in range(100, 180)] + [(i, [i / 7, -i / 3, 0.1]) for i in range(40)] + [(60, None), (61, []), (62, [None, 1.0, 1.0]), (63, [float("nan"), 1.0, 1.0]), (64, [float("inf"), 0.0, 0.0]), (None, hot), (65, [1.0, 2.0]), (70, [1.0, 2.0]), (3, [9.0, 9.0, 9.0]), (3, [9.0, 9.0, 9.0]), (30, hot), (30, [2.0, 2.0, 2.0]), (30, [2.0, 2.0, 2.0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    assert asked(docs, every=10, shard_rows=16, block_rows=3) == brute(rows, every=10)


def test_rows_of_the_same_id_find_each_other(spark):
    rows = [(50, [1.0, 0.0]), (50, [3.0, 0.0]), (51, [2.0, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = 256 * 256
    assert asked(docs) == sorted([(50, 1, 50, 3 * unit), (50, 2, 51, 2 * unit), (50, 1, 51, 6 * unit), (50, 2, 50, 3 * unit)]) == brute(rows)


def clustered():
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (30, 12))
    which = np.r_[np.zeros(1500, int), rng.integers(0, 30, 3000)]  # a third of all rows in one cluster
    points = np.round(centres[which] + rng.normal(0, 0.02, (4500, 12)), 3)
    return [(int(i), p.tolist()) for i, p in zip(rng.permutation(4500), points)] + [(9000 + i, [1.0, float(i)]) for i in range(60)]


def test_few_shards_get_queries_of_clustered_vectors(spark, monkeypatch):
    rows = clustered()
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert asked(docs, shard_rows=128, block_rows=16) == brute(rows)
    whole = docs.withColumn("embedding", quantised(F.col("embedding")))
    portions, trees = topk.shipped(whole, F.col("vec_id") % 50 == 0, shard_rows=128, block_rows=16)
    blocks = portions.select("block").distinct().count()
    assert portions.count() < blocks * trees.count() / 2
    monkeypatch.setattr(topk, "SAMPLE_ROWS", 40)  # a dimension may be missing from the sample
    monkeypatch.setattr(topk, "PORTION", 500)
    assert asked(docs, shard_rows=500, block_rows=16) == brute(rows)


def test_empty_table(spark):
    assert asked(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []
    assert asked(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")) == []


def test_branch_and_bound_skips_points_and_loses_none():
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (20, 8))
    points = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 4, (4000, 8)))
    ids = rng.permutation(4000)
    tree = BallTree.from_bytes(BallTree(ids, points, 64).to_bytes())
    best = TopK(50, 5)
    scored = tree.search(ids[:50], points[:50], best)
    assert scored < 50 * 4000 / 4
    for i in range(50):
        s = exact_scores(points[i : i + 1], points)[0]
        want = sorted((-int(x), int(j)) for x, j in zip(s, ids) if j != ids[i])[:5]
        assert [(-int(x), int(j)) for x, j in zip(best.scores[i], best.ids[i])] == want


def test_equal_points_and_large_values():
    tree = BallTree(np.arange(3000), np.ones((3000, 4)), 16)
    best = TopK(1, 3)
    assert tree.search(np.array([1]), np.ones((1, 4)), best) < 3000
    assert best.ids.tolist() == [[0, 2, 3]]
    big = np.array([[2.0**40, 3.0]])
    assert exact_scores(big, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 3]]
    with pytest.raises(ValueError):
        top_k(None, None, 0)
