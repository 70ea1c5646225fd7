import re

from lodestack.plans import knowledge, retrieval


def word_set(text):
    return set(re.findall("[a-z0-9]+", text.lower()))


def test_documents_that_share_only_common_words_are_scored(spark, tmp_path):
    docs = [(i, f"the common words of all documents {'abc'[i % 3]} own{i}") for i in range(30)]
    items = [(1, "the common words b"), (2, "documents of own7")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["query"], r["doc"]): r["score"] for r in retrieval.overlap(spark, str(tmp_path), 100).collect()}
    want = {(q, d): round(len(word_set(a) & word_set(b)) / len(word_set(a) | word_set(b)), 6) for q, a in items for d, b in docs if word_set(a) & word_set(b)}
    assert got == want and len(want) == 60


def test_keyword_peers_by_whole_texts(spark, sf_dir, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    tail = " ".join(f"keyword{i}" for i in range(60))
    opening = " ".join(f"opening{i}" for i in range(12))
    docs += [(9001, f"{opening} {tail}"), (9002, tail), (9003, tail), (9004, opening + " " + " ".join(f"another{i}" for i in range(60))), (9005, "a b c"), (9006, "b c")]
    docs += [(9100 + k, " ".join(f"border{i}" for i in range(k, 25))) for k in (0, 7, 8)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'src1' AS source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_peers) for r in knowledge.jaccard_keyword_peers(spark, str(tmp_path)).collect()}
    held = {r.doc_id: {w for w in r.w if len(w) > 2} for r in knowledge.words(spark, str(tmp_path)).select("doc_id", "w").collect()}
    want = {}
    for a in held:
        peers = sum(b != a and bool(held[a]) and len(held[a] & held[b]) / len(held[a] | held[b]) >= 0.72 for b in held)
        want[a] = (min(b for b in held if held[b] == held[a]) if held[a] else a, peers)
    assert got == want
    assert got[9003] == (9002, 2) and got[9001][1] == 2 and got[9004] == (9004, 0) and got[9006] == (9006, 0) and got[9107][1] == 2 and got[9100][1] == 1


def test_best_sentences_are_the_plain_ones(spark, monkeypatch):
    import random

    from lodestack.operators import knowledge as K

    rng = random.Random(2)
    sentences = [(d, p, [rng.choice("abcdefghij") for _ in range(rng.randrange(6))]) for d in range(40) for p in range(4)] + [(99, 0, None)]
    asked = [(i, t) for i in range(9) for t in rng.sample("abcdefghijxyz", 4)] + [(0, "a"), (0, "a")]
    want = []
    for i in range(9):
        terms = {t for j, t in asked if j == i}
        scored = sorted((-len(terms & set(w or [])), d, p) for d, p, w in sentences if terms & set(w or []))[:3]
        want += [(i, d, p, -h) for h, d, p in scored]
    s = spark.createDataFrame(sentences, "doc_id long, pos long, terms array<string>")
    q = spark.createDataFrame(asked, "item_id long, term string")
    for block, most in ((512, 300_000), (4, 300_000), (512, 0)):
        monkeypatch.setattr(K, "ITEM_BLOCK", block)
        assert sorted(map(tuple, K.best_sentences(s, q, 3, most).collect())) == sorted(want)
