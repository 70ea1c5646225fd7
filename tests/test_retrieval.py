"""Retrieval operators on small tables, against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestack.operators import blocks as B
from lodestack.operators import retrieval as R


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    docs = [(i, [f"w{min(int(rng.expovariate(0.15)), 60)}" for _ in range(rng.randrange(0, 40))]) for i in range(n)]
    queries = [(1, ["w0", "w1", "w30"]), (2, ["w0", "w0", "w2"]), (3, ["w59", "w40", "w0", "w1", "w2", "w3"]), (4, []), (5, ["unknown"]), (6, ["w0"])]
    return docs, queries


def brute(docs, queries, k):
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for q, asked in queries:
        scores = []
        for d, w in docs:
            tf = Counter(w)
            s = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in asked)
            if any(tf[t] for t in asked):
                scores.append((-round(s, 6), d))
        out += [(q, d, -s, r + 1) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return out


def test_cosine_in_blocks_and_by_join(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(90)] + [(100, None), (101, [0.0] * 5), (102, [1.0, 2.0]), (103, [None, 1.0, 1.0, 1.0, 1.0]), (104, [3.0, 4.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id % 10 = 0 OR id = 102").withColumnRenamed("id", "q")
    plain = {i: x for i, x in rows if x and None not in x and any(x)}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)
    want = {}
    for i, a in plain.items():
        if i % 10 == 0 or i == 102:
            best = sorted((-cos(a, b), j) for j, b in plain.items() if len(a) == len(b))[:4]
            want |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(best)}
    for most in (10**8, 0):
        monkeypatch.setattr(R, "BROADCAST_BYTES", most)
        monkeypatch.setattr(R, "QUERY_BLOCK", 3)
        assert {(r["query"], r["rank"]): (r.doc, r.score) for r in R.cosine_top_k(v, q, "id", "q", "v", 4).collect()} == want


def test_index_store_keeps_what_is_there(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "id long, words array<string>")
    store = R.IndexStore(spark, str(tmp_path / "store"))
    assert store.read().collect() == []
    store.add(frame([(1, ["a", "b", "a"]), (2, ["a"]), (3, [])]), "id", "words")
    store.add(frame([(2, ["c"])]), "id", "words").remove(spark.createDataFrame([(1,)], "doc long"))
    store.add(frame([(1, ["d"])]), "id", "words")
    assert sorted((r.doc, r.term, r.tf) for r in store.read().where("term <> ''").collect()) == [(1, "d", 1), (2, "c", 1)]
    assert R.corpus_size(store.read())[0] == 3


def test_vector_store_keeps_what_is_there(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    store = R.VectorStore(spark, str(tmp_path / "vectors"))
    asked = frame([(1, [1.0, 0.0])])
    assert store.read().collect() == [] and store.search(asked, "id", "v", 3).collect() == []
    store.add(frame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None)]), "id", "v")
    store.remove(spark.createDataFrame([(1,)], "doc long")).add(frame([(2, [2.0, 0.1])]), "id", "v")
    assert sorted((r.doc, r.vector) for r in store.read().collect() if r.vector) == [(2, [2.0, 0.1]), (3, [1.0, 1.0])]
    assert [(r.doc, r["rank"]) for r in store.search(asked, "id", "v", 3).orderBy("rank").collect()] == [(2, 1), (3, 2)]
    store.add(frame([(1, [1.0, 0.0])]), "id", "v")
    assert store.search(asked, "id", "v", 1).first().doc == 1


def test_shared_windows(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, words), (2, words[5:15]), (3, words[:9]), (4, words[20:28] + words[5:14]), (5, None)], "id long, words array<string>")
    items = spark.createDataFrame([(1, words[:20]), (2, words[30:])], "q long, words array<string>")
    assert sorted(tuple(r) for r in R.sharing_windows(docs, items, "id", "q", "words").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_index_is_written_once_for_the_same_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.select("doc_id", F.split("text", " ").alias("words"))
    a, b = (R.keyword_index(docs, own, "doc_id", "words", "once") for _ in range(2))
    assert a.inputFiles() == b.inputFiles() and R.keyword_index(docs, own, "doc_id", "words", "other").inputFiles() != a.inputFiles()


def test_matrices_and_counts_are_of_one_size(monkeypatch):
    """A task's memory must not go with the number of queries and of long texts; scores were a matrix of all of both."""
    rng = np.random.default_rng(3)
    q, d = rng.integers(-2, 3, (50, 4)) + 0.5, rng.integers(-2, 3, (400, 4)) + 0.5
    q[7], d[9] = np.nan, np.inf
    held = []
    monkeypatch.setattr(R, "SCORES", 1200)
    monkeypatch.setattr(R.np, "outer", lambda a, b, f=np.outer: (held.append(len(a) * len(b)), f(a, b))[1])
    with np.errstate(invalid="ignore"):
        got = [r for b in R._best((np.arange(50), q), (np.arange(400)[::-1], d), 5) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        scores = np.round((q @ d.T) / np.sqrt(((q * q).sum(axis=1))[:, None] * (d * d).sum(axis=1)), 6)
    assert max(held) <= 1200
    want = [(i, 399 - j) for i in range(50) for j in np.lexsort((np.arange(400)[::-1], -scores[i]))[:5]]
    assert [(a, b) for a, b, _ in got] == want
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([["a"] * 4, None, [], ["b"] * 9, ["c"], ["d"] * 3])], names=["k", "w"])
    assert [b.column(0).to_pylist() for b in R.by_words([batch, batch.slice(0, 0)], 4)] == [[0, 1, 2], [3], [4, 5]]


def test_shards_are_bounded_by_words_too(spark, monkeypatch):
    """8192 texts of 20,000 words are 160 million words for one task."""
    monkeypatch.setattr(B, "SHARD_WORDS", 100)
    docs = spark.createDataFrame([(i, [f"w{i % 7}"] * 30) for i in range(40)], "id long, words array<string>").coalesce(1)
    lengths = [sum(r.dl) for r in B.block_index(docs, "id", "words").where("term = ''").collect()]
    assert sum(lengths) == 1200 and max(lengths) < 130


def test_overlap_is_that_of_plain_sets_and_pairs_are_never_rows(spark, monkeypatch):
    """Every pair of a text and a query with a common word was a row of a shuffle, nearly all pairs."""
    import random

    from lodestack.operators import retrieval as R

    rng, vocabulary = random.Random(5), [f"w{i}" for i in range(90)]
    lists = [[rng.choice(vocabulary[: rng.choice([4, 90])]) for _ in range(rng.randrange(0, 40))] for _ in range(150)] + [None, [], vocabulary[:64], ["only"], [f"x{i}" for i in range(127)] + ["w0"]]
    asks = [rng.sample(vocabulary, rng.randrange(1, 12)) for _ in range(20)] + [[], None, ["w0"], ["nowhere"]]
    docs = spark.createDataFrame([*enumerate(lists), (None, ["w0"])], "d long, words array<string>").repartition(4)
    queries = spark.createDataFrame([*enumerate(asks), (None, ["w0"])], "q int, words array<string>")
    want = []
    for q, a in enumerate(asks):
        own = []
        for d, ws in enumerate(lists):
            n, u = len(set(a or []) & set(ws or [])), len(set(a or []) | set(ws or []))
            own += [(-((2_000_000 * n + u) // (2 * u)) / 1e6, d)] if n else []
        want += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(own)[:7])]
    for rows, cells, scores in ((200_000, 4_000_000, 1_000_000), (30, 60, 50)):  # whole, and in several passes, matrices and steps
        monkeypatch.setattr(R, "OVERLAP_ROWS", rows), monkeypatch.setattr(R, "OVERLAP_CELLS", cells), monkeypatch.setattr(R, "SCORES", scores)
        got = R.overlap_top_k(docs, queries, "d", "q", "words", 7)
        assert sorted((r.query, r.doc, r.score, r.rank) for r in got.collect()) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_hashed_vectors_are_made_by_the_worker_that_scores_them(spark, sf_dir, monkeypatch):
    """A task had two Python workers, one that made the vectors and one that scored them."""
    from lodestack.operators import retrieval as R
    from lodestack.plans import retrieval as P

    d, q = P.corpus(spark, sf_dir), R.hashed_vectors(P.asked(spark, sf_dir), "item_id", "words")
    d = d.unionByName(spark.createDataFrame([(-1, None), (-2, [])], "doc_id long, words array<string>"))
    apart = sorted(map(tuple, R.cosine_top_k(R.hashed_vectors(d, "doc_id", "words"), q, "doc_id", "item_id", "vector", 5).collect()))
    for most in (R.BROADCAST_BYTES, 0):  # sent to all tasks, and joined
        monkeypatch.setattr(R, "BROADCAST_BYTES", most)
        together = R.cosine_top_k(d, q, "doc_id", "item_id", "vector", 5, "words", R.hashed)
        assert sorted(map(tuple, together.collect())) == apart
    monkeypatch.undo()
    assert P.near(spark, sf_dir, 5)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_shared_windows_are_those_of_plain_runs_and_only_they_are_rows(spark, monkeypatch):
    """All runs of all texts were made as strings and joined."""
    import random

    from lodestack.operators import retrieval as R

    rng = random.Random(8)
    asks = [[rng.choice("abcd") for _ in range(rng.randrange(0, 9))] for _ in range(12)] + [None, []]
    lists = [[rng.choice("abcdefg") for _ in range(rng.randrange(0, 30))] for _ in range(60)] + [asks[0] + ["z"] + asks[1], None, [], ["a"]]
    runs = lambda ws: {tuple(ws[i : i + 4]) for i in range(len(ws or []) - 3)}
    want = {(q, d) for q, a in enumerate(asks) for d, ws in enumerate(lists) if runs(a) & runs(ws)}
    docs = spark.createDataFrame(list(enumerate(lists)), "d long, words array<string>").repartition(3)
    items = spark.createDataFrame(list(enumerate(asks)), "q long, words array<string>")
    for most in (R.BROADCAST_ROWS, 1):
        monkeypatch.setattr(R, "BROADCAST_ROWS", most)
        assert {tuple(r) for r in R.sharing_windows(docs, items, "d", "q", "words", 4).collect()} == want and want
    got = R._runs_with_hash(docs.selectExpr("d AS doc", "words"), [a for a in asks if a], 4).collect()
    assert {tuple(r.run.split()) for r in got} <= set().union(*map(runs, asks))
