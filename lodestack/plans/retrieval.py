"""Retrieval queries: keyword index, BM25, cosine, fusion, hybrid search and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.operators import blocks as B
from lodestack.operators import retrieval as R
from lodestack.operators import textvectors as V
from lodestack.plans.registry import query
from lodestack.session import table
from lodestack.shared import new_path, written

WORDS_SQL = f"""WITH d AS (SELECT doc_id AS doc, {X.tokens_sql('text')} AS w FROM documents), q AS (SELECT item_id AS query, {X.tokens_sql('text')} AS w FROM benchmark) """
BM25_SQL = WORDS_SQL + """, asked AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest(w) AS term FROM q) GROUP BY 1, 2), stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT query, doc, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN asked USING (term), stats GROUP BY 1, 2),
sparse AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM scored) """
COSINE_SQL = """, u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
cosine AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM u a, u b WHERE a.vec_id % 25 = 0),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM cosine) """
#: Vectors of texts: how many of their words fall on each first byte of MD5.
HASHED_SQL = """, dv AS (SELECT doc, b, count(*) AS n FROM (SELECT doc, substr(md5(unnest(w)), 1, 2) AS b FROM d) GROUP BY 1, 2), qv AS (SELECT query, b, count(*) AS n FROM (SELECT query, substr(md5(unnest(w)), 1, 2) AS b FROM q) GROUP BY 1, 2),
dn AS (SELECT doc, sum(n * n) AS s FROM dv GROUP BY 1), qn AS (SELECT query, sum(n * n) AS s FROM qv GROUP BY 1), dots AS (SELECT query, doc, sum(dv.n * qv.n) AS dot FROM dv JOIN qv USING (b) GROUP BY 1, 2),
hashed AS (SELECT query, doc, round(dot / sqrt(CAST(dn.s AS DOUBLE) * CAST(qn.s AS DOUBLE)), 6) AS score FROM dots JOIN dn USING (doc) JOIN qn USING (query)),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM hashed) """


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("words"))


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("words"))


def index(spark, sf_dir):
    return R.keyword_index(table(spark, sf_dir, "documents"), corpus(spark, sf_dir), "doc_id", "words", "documents")


def blocks(spark, sf_dir):
    return B.stored_index(table(spark, sf_dir, "documents"), corpus(spark, sf_dir), "doc_id", "words", "documents")


def sparse(spark, sf_dir, k):
    return B.bm25_search(blocks(spark, sf_dir), asked(spark, sf_dir), "item_id", "words", k)


def dense(spark, sf_dir, k):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return R.cosine_top_k(v, v.where("vec_id % 25 = 0").withColumnRenamed("vec_id", "q"), "vec_id", "q", "embedding", k)


def near(spark, sf_dir, k):
    q = R.hashed_vectors(asked(spark, sf_dir), "item_id", "words")
    return R.cosine_top_k(corpus(spark, sf_dir), q, "doc_id", "item_id", "vector", k, "words", R.hashed)


@query("postings_statistics", BM25_SQL + "SELECT term, df FROM df WHERE df >= 2")
def postings_statistics(spark, sf_dir):
    own = index(spark, sf_dir).join(asked(spark, sf_dir).select(F.explode("words").alias("term")).distinct(), "term", "left_semi")
    return own.groupBy("term").agg(F.count("*").alias("df")).where("df >= 2")


@query("corpus_statistics", WORDS_SQL + "SELECT count(*) AS documents, round(avg(len(w)), 6) AS mean_length FROM d")
def corpus_statistics(spark, sf_dir):
    own = index(spark, sf_dir).where("term = ''")
    return own.agg(F.count("*").alias("documents"), F.round(F.avg("dl"), 6).alias("mean_length"))


@query("index_add_remove", WORDS_SQL + """, kept AS (SELECT doc, CASE WHEN doc % 7 = 0 THEN w[1:20] ELSE w END AS w FROM d WHERE doc % 5 <> 0 OR doc % 7 = 0), e AS (SELECT doc, unnest(w) AS term FROM kept)
SELECT term, count(*) AS tf, count(DISTINCT doc) AS df FROM e GROUP BY 1""")
def index_add_remove(spark, sf_dir):
    """An index that gets two thirds of the documents, then the rest, loses every fifth, and gets every seventh again with its first twenty words."""
    own = corpus(spark, sf_dir)
    store = R.IndexStore(spark, new_path(spark, "index-store"))
    store.add(own.where("doc_id % 3 > 0"), "doc_id", "words").add(own.where("doc_id % 3 = 0"), "doc_id", "words")
    store.remove(own.where("doc_id % 5 = 0").select(F.col("doc_id").alias("doc")))
    store.add(own.where("doc_id % 7 = 0").withColumn("words", F.slice("words", 1, 20)), "doc_id", "words")
    return store.read().where("term <> ''").groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("index_sync_check", "SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'no_vector' ELSE 'no_document' END AS lacks FROM documents FULL JOIN embeddings ON doc_id = vec_id WHERE vec_id IS NULL UNION ALL SELECT vec_id, 'no_document' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def index_sync_check(spark, sf_dir):
    """Documents that the keyword index has and the vectors lack, and the other way round: what a rebuild must make anew."""
    words, vectors = index(spark, sf_dir).where("term = ''").select(F.col("doc").alias("doc_id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    lacks = lambda a, b, what: a.join(b, "doc_id", "left_anti").withColumn("lacks", F.lit(what))
    return lacks(words, vectors, "no_vector").unionByName(lacks(vectors, words, "no_document"))


@query("bm25_topk", BM25_SQL + "SELECT query, doc, score, rank FROM sparse WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return sparse(spark, sf_dir, 10).select("query", "doc", "score", "rank")


@query("bm25_filtered_after_rank", BM25_SQL + "SELECT query, doc, rank FROM sparse JOIN documents ON doc = doc_id WHERE rank <= 20 AND lang = 'en'")
def bm25_filtered_after_rank(spark, sf_dir):
    """Ranks are over the whole corpus; the filter comes after and may leave fewer rows."""
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    return sparse(spark, sf_dir, 20).join(english, "doc", "left_semi").select("query", "doc", "rank")


@query("bm25_allowed_topk", BM25_SQL + """, fit AS (SELECT query, doc, score, rank, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM sparse JOIN documents ON doc = doc_id WHERE lang = 'es')
SELECT query, doc, score, rank, CAST(place AS INTEGER) AS place FROM fit WHERE place <= 10""")
def bm25_allowed_topk(spark, sf_dir):
    """The ten best Spanish documents of each item, found by fetching more until there are ten."""
    allowed = table(spark, sf_dir, "documents").where("lang = 'es'").select(F.col("doc_id").alias("doc"))
    return B.bm25_search_allowed(blocks(spark, sf_dir), asked(spark, sf_dir), "item_id", "words", allowed, 10)


@query("cosine_topk", "WITH one AS (SELECT 1) " + COSINE_SQL + "SELECT query, doc, score, rank FROM dense WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    return dense(spark, sf_dir, 10)


@query("cosine_calibrated", "WITH one AS (SELECT 1) " + COSINE_SQL + "SELECT query, doc, round(least(greatest((greatest(score, 0) - 0.15::DOUBLE) / 0.75::DOUBLE, 0), 1), 4) AS score FROM dense WHERE rank <= 10 AND score > 0.05")
def cosine_calibrated(spark, sf_dir):
    return dense(spark, sf_dir, 10).where("score > 0.05").select("query", "doc", X.calibrated(F.greatest("score", F.lit(0.0))).alias("score"))


STORE_SQL = """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
now AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM u WHERE vec_id % 5 <> 0 OR vec_id % 7 = 0),
scored AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM u a, now b WHERE a.vec_id % 25 = 0),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM scored) """


def changed_vectors(spark, sf_dir):
    """A store that gets two thirds of the vectors, then the rest, loses every fifth, and gets every seventh again with the other sign; and the queries."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    store = R.VectorStore(spark, new_path(spark, "vector-store"))
    store.add(own.where("vec_id % 3 > 0"), "vec_id", "v").add(own.where("vec_id % 3 = 0"), "vec_id", "v")
    store.remove(own.where("vec_id % 5 = 0").select(F.col("vec_id").alias("doc")))
    store.add(own.where("vec_id % 7 = 0").withColumn("v", F.transform("v", lambda x: -x)), "vec_id", "v")
    return store, own.where("vec_id % 25 = 0").select(F.col("vec_id").alias("q"), "v")


@query("vector_add_remove", STORE_SQL + "SELECT query, doc, score, rank FROM ranks WHERE rank <= 10")
def vector_add_remove(spark, sf_dir):
    store, asked = changed_vectors(spark, sf_dir)
    return store.search(asked, "q", "v", 10)


@query("vector_overfetch", STORE_SQL + ", fit AS (SELECT ranks.*, CAST(row_number() OVER (PARTITION BY query ORDER BY rank) AS INTEGER) AS place FROM ranks JOIN embeddings ON doc = vec_id WHERE label = 3) SELECT query, doc, score, rank, place FROM fit WHERE place <= 5")
def vector_overfetch(spark, sf_dir):
    """The five nearest vectors of one label, with their rank among all."""
    store, asked = changed_vectors(spark, sf_dir)
    allowed = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc"))
    return B.overfetched(lambda left, n: store.search(left, "q", "v", n), asked, "q", allowed, 5)


@query("hashed_vector_topk", WORDS_SQL + HASHED_SQL + "SELECT query, doc, score, rank FROM near WHERE rank <= 20")
def hashed_vector_topk(spark, sf_dir):
    """Texts by the cosine of their hashed vectors."""
    return near(spark, sf_dir, 20)


def fused_sql(dense_name: str) -> str:
    return f""", fused AS (SELECT coalesce(o.query, m.query) AS query, coalesce(o.doc, m.doc) AS doc, o.rank AS dense_rank, m.rank AS sparse_rank, round(coalesce(0.6::DOUBLE / (60 + o.rank), 0) + coalesce(0.4::DOUBLE / (60 + m.rank), 0), 6) AS score
  FROM (SELECT * FROM {dense_name} WHERE rank <= 20) o FULL JOIN (SELECT query, doc, rank FROM sparse WHERE rank <= 20) m ON o.query = m.query AND o.doc = m.doc),
final AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, coalesce(dense_rank, 9999), coalesce(sparse_rank, 9999), doc) AS INTEGER) AS rank FROM fused) """


FUSED_SQL = BM25_SQL + HASHED_SQL + fused_sql("near")
HITS_SQL = """, h AS (SELECT gold.query, rank FROM gold LEFT JOIN (SELECT * FROM final WHERE rank <= 5) f ON f.query = gold.query AND f.doc = gold.doc)
SELECT query, round(count(*) FILTER (rank <= 1) / count(*), 6) AS recall_1, round(count(*) FILTER (rank <= 3) / count(*), 6) AS recall_3, round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_5,
  round(coalesce(1 / min(rank), 0), 6) AS reciprocal_rank, round(count(*) FILTER (rank <= 5) / 5, 6) AS precision_5 FROM h GROUP BY 1"""
TRACE_SQL = """SELECT gold.query, gold.doc, CASE WHEN f.rank <= 5 THEN 'returned' WHEN f.rank IS NOT NULL THEN 'fused_too_low' ELSE 'not_found' END AS verdict
FROM gold LEFT JOIN final f ON f.query = gold.query AND f.doc = gold.doc"""


def fused(spark, sf_dir, k):
    return R.fuse(near(spark, sf_dir, 20), sparse(spark, sf_dir, 20), k, 0.6, 0.4)


@query("hybrid_retrieval", FUSED_SQL + "SELECT query, doc, dense_rank, sparse_rank, score, rank FROM final WHERE rank <= 5")
def hybrid_retrieval(spark, sf_dir):
    """Two ranked lists of 20 each, by hashed vectors and by BM25, fused by reciprocal ranks to the best 5."""
    return fused(spark, sf_dir, 5)


GOLD_SQL = """, runs AS (SELECT query, unnest(list_transform(range(len(w) - 9), lambda i: array_to_string(w[i + 1:i + 10], ' '))) AS run FROM q WHERE len(w) >= 10),
held AS (SELECT doc, unnest(list_transform(range(len(w) - 9), lambda i: array_to_string(w[i + 1:i + 10], ' '))) AS run FROM d WHERE len(w) >= 10), gold AS (SELECT DISTINCT query, doc FROM runs JOIN held USING (run)) """


def gold(spark, sf_dir):
    """Documents that share any ten words in a row with an item."""
    return R.sharing_windows(corpus(spark, sf_dir), asked(spark, sf_dir), "doc_id", "item_id", "words")


def traced(relevant, ranked):
    verdict = F.when(F.col("rank") <= 5, "returned").when(F.col("rank").isNotNull(), "fused_too_low").otherwise("not_found")
    return relevant.join(ranked.select("query", "doc", "rank"), ["query", "doc"], "left").select("query", "doc", verdict.alias("verdict"))


@query("recall_mrr_at_k", FUSED_SQL + GOLD_SQL + HITS_SQL)
def recall_mrr_at_k(spark, sf_dir):
    return R.judged(hybrid_retrieval(spark, sf_dir), gold(spark, sf_dir))


@query("trace_lost_documents", FUSED_SQL + GOLD_SQL + TRACE_SQL)
def trace_lost_documents(spark, sf_dir):
    return traced(gold(spark, sf_dir), fused(spark, sf_dir, 40))


#: The same with the overlap of whole sets of words in the place of vectors.
WHOLE_SQL = BM25_SQL + """, dt AS (SELECT DISTINCT doc, term FROM (SELECT doc, unnest(w) AS term FROM d)), qt AS (SELECT query, term FROM asked),
dn AS (SELECT doc, count(*) AS n FROM dt GROUP BY 1), qn AS (SELECT query, count(*) AS n FROM qt GROUP BY 1), lexical AS (SELECT query, doc, count(*) AS n FROM dt JOIN qt USING (term) GROUP BY 1, 2),
overlap AS (SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY round(l.n / (dn.n + qn.n - l.n), 6) DESC, doc) AS INTEGER) AS rank FROM lexical l JOIN dn USING (doc) JOIN qn USING (query)) """ + fused_sql("overlap")


def overlap(spark, sf_dir, k):
    """Jaccard similarity of the sets of words; only documents that share one with a query are scored."""
    return R.overlap_top_k(corpus(spark, sf_dir), asked(spark, sf_dir), "doc_id", "item_id", "words", k)


def fused_whole(spark, sf_dir, k):
    return R.fuse(overlap(spark, sf_dir, 20), sparse(spark, sf_dir, 20), k, 0.6, 0.4)


@query("hybrid_retrieval_all_words", WHOLE_SQL + "SELECT query, doc, dense_rank, sparse_rank, score, rank FROM final WHERE rank <= 5")
def hybrid_retrieval_all_words(spark, sf_dir):
    return fused_whole(spark, sf_dir, 5)


@query("recall_mrr_at_k_all_words", WHOLE_SQL + GOLD_SQL + HITS_SQL)
def recall_mrr_at_k_all_words(spark, sf_dir):
    return R.judged(hybrid_retrieval_all_words(spark, sf_dir), gold(spark, sf_dir))


@query("trace_lost_documents_all_words", WHOLE_SQL + GOLD_SQL + TRACE_SQL)
def trace_lost_documents_all_words(spark, sf_dir):
    return traced(gold(spark, sf_dir), fused_whole(spark, sf_dir, 40))


def text_near(spark, sf_dir, k):
    """By the cosine of text vectors that are learnt from the documents."""
    held, q = written(V.counts(corpus(spark, sf_dir), "doc_id", "words"), "text-counts"), asked(spark, sf_dir)
    basis = V.fit_counts(held)
    return R.cosine_top_k(V.vectors_of_counts(held, "doc_id", basis), V.text_vectors(q, "item_id", "words", basis), "doc_id", "item_id", "vector", k)


@query("text_vector_topk")
def text_vector_topk(spark, sf_dir):
    """The twenty nearest documents of each item by learnt text vectors."""
    return text_near(spark, sf_dir, 20)


@query("hybrid_text_vectors")
def hybrid_text_vectors(spark, sf_dir):
    """As hybrid_retrieval, with learnt text vectors in the place of hashed counts."""
    return R.fuse(text_near(spark, sf_dir, 20), sparse(spark, sf_dir, 20), 5, 0.6, 0.4)


@query("text_vector_recall")
def text_vector_recall(spark, sf_dir):
    """Recall, reciprocal rank and precision of the vectors alone, by documents that share ten words in a row with an item."""
    return R.judged(text_near(spark, sf_dir, 20), gold(spark, sf_dir), (1, 5, 20))
