"""Document preparation, web pages and the event stream as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.operators import ingestion as I
from lodestack.operators import retrieval as R
from lodestack.plans.registry import query
from lodestack.session import table
from lodestack.shared import new_path
from lodestack.streaming import changes as L
from lodestack.streaming import events as E


@query("sentence_chunks")
def sentence_chunks(spark, sf_dir):
    """All chunks of all documents; the tests hold them against the chunker on each text."""
    return I.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("normalised_texts")
def normalised_texts(spark, sf_dir):
    """Texts in normal form, cleaned of OCR traces."""
    return I.normalised(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(I.ocr_cleaned(F.col("text"))).alias("digest"), F.length("text").alias("n_chars"))


@query("document_lines", r"SELECT doc_id, unnest(range(len(l))) AS at, unnest(l) AS line, unnest(list_transform(l, lambda x: trim(x) = '')) AS blank, unnest(list_transform(l, lambda x: length(x) - length(ltrim(x)))) AS indent FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def document_lines(spark, sf_dir):
    rows = I.lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("at").cast("long").alias("at"), "line", "blank", F.col("indent").cast("long").alias("indent"))


@query("paragraph_counts", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n([ ]*\n)+')) AS p FROM documents) WHERE trim(p, ' ' || chr(10)) <> '' GROUP BY 1")
def paragraph_counts(spark, sf_dir):
    return I.paragraphs(I.lines(table(spark, sf_dir, "documents"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("section_chunks")
def section_chunks(spark, sf_dir):
    """Chunks that keep to the sections of a document and name their path."""
    return I.section_chunks(I.sections(I.headings(I.lines(table(spark, sf_dir, "documents")))))


@query("page_titles", r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, strlen(html) AS n_bytes FROM pages")
def page_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1).alias("host"), F.octet_length("html").cast("long").alias("n_bytes"))


@query("pages_per_host", r"SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS n, sum(strlen(html)) AS n_bytes FROM pages GROUP BY 1")
def pages_per_host(spark, sf_dir):
    return page_titles(spark, sf_dir).groupBy("host").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))


@query("stream_daily_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    """The event table read as a stream up to its end. Counts that a batch changes are appended to a table of the shared folder; the newest
    of a day, which is the largest, holds."""
    live = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    path = new_path(spark, "stream")
    run = E.daily_counts(live).writeStream.outputMode("update").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/counts/batch={number}"))
    run.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/counts").groupBy("day", "event_type").agg(F.max("n").alias("n"))


def replayed(spark, sf_dir):
    """Stores filled from three quarters of the documents, then kept by a log: the rest comes; every fifth goes and every seventh gets other words; every third is made anew,
    every eleventh goes, and every thirty-fifth comes again as it was."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    path = new_path(spark, "replay")
    words = lambda d: d.select("doc", X.tokens(F.col("text")).alias("words"))
    stores = L.Stores(spark, f"{path}/stores", {"postings": lambda d: R.postings(words(d), "doc", "words"), "vectors": lambda d: R.hashed_vectors(words(d), "doc", "words"), "chunks": lambda d: I.chunks(d, "doc")})
    log = L.ChangeLog(spark, f"{path}/log")
    change = lambda d, operation, step=0: d.select("doc", F.lit(operation).alias("operation"), "text", F.lit(step).alias("step"))
    stores.bootstrap(own.where("doc % 4 > 0"))
    stores.keep(log.append(change(own.where("doc % 4 = 0"), "uploaded"), 0))
    log.append(change(own.where("doc % 5 = 0"), "deleted").union(change(own.where("doc % 7 = 0").withColumn("text", F.concat(F.lit("Another beginning. "), F.coalesce("text", F.lit("")))), "uploaded", 1)), 1, "step", "doc")
    log.append(change(own.where("doc % 3 = 0"), "reindexed").union(change(own.where("doc % 11 = 0"), "deleted", 1)).union(change(own.where("doc % 35 = 0"), "uploaded", 2)), 2, "step", "doc")
    return stores.keep(log)


@query("replayed_stores", f"""WITH t AS (SELECT doc_id AS doc, CASE WHEN doc_id % 35 = 0 OR doc_id % 7 > 0 THEN text ELSE concat('Another beginning. ', text) END AS text FROM documents WHERE doc_id % 35 = 0 OR (doc_id % 11 > 0 AND (doc_id % 7 = 0 OR doc_id % 5 > 0))),
w AS (SELECT doc, {X.tokens_sql('text')} AS w FROM t) SELECT doc, len(w) AS n_words, len(list_distinct(w)) AS n_terms, CAST(len(w) AS DOUBLE) AS vector_total FROM w""")
def replayed_stores(spark, sf_dir):
    """What postings and vectors say of each document after a log of changes was read as a stream."""
    stores = replayed(spark, sf_dir)
    terms = stores.read("postings").groupBy("doc").agg(F.max("dl").cast("long").alias("n_words"), (F.count("*") - 1).alias("n_terms"))
    return terms.join(stores.read("vectors").select("doc", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("vector_total")), "doc")


@query("replayed_chunks")
def replayed_chunks(spark, sf_dir):
    """Chunks of the documents that the same log leaves."""
    return replayed(spark, sf_dir).read("chunks")
