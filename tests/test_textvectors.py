"""Learnt text vectors against a dense decomposition, and their recall of planted passages."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import retrieval as R
from lodestack.operators import textvectors as V
from lodestack.plans import retrieval as P

COLUMNS = 40


def matrix(lists, idf_of):
    out = np.zeros((len(lists), COLUMNS))
    for i, words in enumerate(lists):
        for c, n in Counter(zlib.crc32(w.encode()) % COLUMNS for w in words or []).items():
            out[i, c] = (1 + np.log(n)) * idf_of[c]
        length = np.linalg.norm(out[i])
        out[i] /= length or 1
    return out


def texts(seed=2, n=90):
    rng = random.Random(seed)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(4)]
    return [[rng.choice(topics[i % 4]) if rng.random() < 0.8 else f"x{rng.randrange(60)}" for _ in range(rng.randrange(1, 30))] for i in range(n)] + [[], None]


def test_agrees_with_a_dense_decomposition(spark):
    lists = texts()
    docs = spark.createDataFrame(list(enumerate(lists)), "id long, words array<string>").repartition(5)
    basis = V.fit(docs, "id", "words", dims=6, columns=COLUMNS, rounds=8)
    df = Counter(c for ws in lists for c in {zlib.crc32(w.encode()) % COLUMNS for w in ws or []})
    idf = np.array([np.log((1 + len(lists)) / (1 + df[c])) + 1 for c in range(COLUMNS)])
    assert np.allclose(basis.idf, idf)
    a = matrix(lists, idf)
    _, values, right = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(basis.values, values[:6], atol=1e-6)
    assert np.allclose(np.abs(basis.vectors.T @ right[:6].T), np.eye(6), atol=1e-3)
    got = {r.id: np.array(r.vector) for r in V.text_vectors(docs, "id", "words", basis).collect()}
    for i in range(len(lists)):
        assert np.allclose(got[i], a[i] @ basis.vectors, atol=1e-9)


def test_reruns_and_partitions_agree_and_odd_tables_work(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "id long, words array<string>")
    one, other = (V.fit(d, "id", "words", dims=5, columns=COLUMNS) for d in (docs.coalesce(1), docs.repartition(7)))
    assert np.allclose(one.vectors, other.vectors, atol=1e-6)
    none = V.fit(docs.limit(0), "id", "words", dims=5, columns=COLUMNS)
    assert not none.vectors.any() and V.text_vectors(docs.limit(0), "id", "words", none).count() == 0
    few = V.fit(docs.where("id < 2"), "id", "words", dims=5, columns=COLUMNS)
    assert (few.values > 1e-9).sum() <= 2 and np.isfinite(few.vectors).all()
    with pytest.raises(ValueError):
        V.fit(docs, "id", "words", dims=0)


def test_planted_passages_are_found_more_often_than_by_hashed_counts(spark):
    sf = "/root/testdata/sf0.01"
    d, q, gold = P.corpus(spark, sf), P.asked(spark, sf), P.gold(spark, sf)

    def hits(docs, items):
        best = R.cosine_top_k(docs, items, "doc_id", "item_id", "vector", 20)
        return gold.join(best, ["query", "doc"]).count()

    hashed = hits(R.hashed_vectors(d, "doc_id", "words"), R.hashed_vectors(q, "item_id", "words"))
    basis = V.fit(d, "doc_id", "words")
    learnt = hits(V.text_vectors(d, "doc_id", "words", basis), V.text_vectors(q, "item_id", "words", basis))
    print(f"of {gold.count()} passages: hashed {hashed}, learnt {learnt}")
    assert learnt > hashed * 1.5


def test_queries(spark, sf_dir):
    assert P.text_vector_topk(spark, sf_dir).groupBy("query").count().where(F.col("count") <= 20).count() == 40
    fused = P.hybrid_text_vectors(spark, sf_dir)
    assert fused.where("rank > 5").count() == 0
    assert set(P.text_vector_recall(spark, sf_dir).columns) == {"query", "recall_1", "recall_5", "recall_20", "reciprocal_rank", "precision_20"}


def test_texts_are_counted_once_and_products_are_those_of_plain_rows(spark, monkeypatch):
    """Each round of the fit, idf and the vectors took the words of all texts apart again, and went through a text at a time."""
    lists = texts(n=40)
    docs = spark.createDataFrame(list(enumerate(lists)), "id long, words array<string>").repartition(3)
    held = V.counts(docs, "id", "words", COLUMNS)
    got = {r.id: dict(zip(np.frombuffer(r.at, np.int32).tolist(), np.frombuffer(r.tf, np.int32).tolist())) for r in held.collect()}
    assert got == {i: dict(Counter(zlib.crc32(w.encode()) % COLUMNS for w in ws or [])) for i, ws in enumerate(lists)}
    idf = np.random.default_rng(1).uniform(1, 8, COLUMNS)  # columns on both sides of COMMON
    a, q = matrix(lists, idf), np.random.default_rng(2).standard_normal((COLUMNS, 4))
    monkeypatch.setattr(V, "DENSE_ROWS", 7)
    rows, products = held.orderBy("id").toArrow().combine_chunks().to_batches()[0], V._Products(idf, q)
    assert 0 < len(products.common) < COLUMNS
    total, dense, outs = np.zeros_like(q), np.zeros_like(products.dense), []
    for part, row, column, tf in V._runs([rows.slice(0, 5), rows.slice(5)], 60):
        for _, some, others, out in products.of(part.num_rows, row, column, tf):
            products.add(total, dense, some, others, out)
            outs.append(out)
    total[products.common] += dense
    assert np.allclose(np.concatenate(outs), a @ q) and np.allclose(total, a.T @ (a @ q))


def test_the_basis_is_fitted_to_all_texts_however_many(spark, monkeypatch):
    """Beyond FIT_TEXTS texts the basis was fitted to a share of them, by the hash of their keys."""
    monkeypatch.setattr(V, "FIT_TEXTS", 30, raising=False)
    lists = texts()
    basis = V.fit(spark.createDataFrame(list(enumerate(lists)), "id long, words array<string>"), "id", "words", dims=6, columns=COLUMNS, rounds=8)
    assert np.allclose(basis.values, np.linalg.svd(matrix(lists, basis.idf), compute_uv=False)[:6], atol=1e-6)
