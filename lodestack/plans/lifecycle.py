"""Documents through their life, runs and their history, plans of questions, and what retrieval leads to."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import fixed as V
from lodestack.functions.bindings import DOCS_SQL, MESSAGES_SQL, documents, messages
from lodestack.operators import knowledge as K
from lodestack.operators import lifecycle as L
from lodestack.operators import planning as P
from lodestack.operators import relational as R
from lodestack.operators import retrieval as T
from lodestack.plans import enrichment as E
from lodestack.plans import retrieval as S
from lodestack.plans.passages import BONUS_SQL, PLAN_SQL, metadata_bonus
from lodestack.plans.planning import QUESTIONS_SQL, questions
from lodestack.plans.registry import query
from lodestack.plans.reporting import STATUS_SQL, status
from lodestack.session import table
from lodestack.shared import new_path, small, written

WITH_DOCS = f"WITH {DOCS_SQL} "


def stated(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "collection", status().alias("status"))


@query("retry_documents", WITH_DOCS + f", d AS (SELECT doc_id, {STATUS_SQL} AS status FROM docs), r AS (SELECT DISTINCT doc_id * 3 AS doc_id FROM docs) SELECT r.doc_id, CASE WHEN d.doc_id IS NULL THEN 'not_found' WHEN status IN ('failed', 'retry_pending') THEN 'scheduled' ELSE 'not_eligible' END AS event FROM r LEFT JOIN d USING (doc_id)")
def retry_documents(spark, sf_dir):
    """Events of requests to try documents again."""
    d = stated(spark, sf_dir)
    return L.retried(d, d.select((F.col("doc_id") * 3).alias("doc_id")))[1]


@query("retried_states", WITH_DOCS + f"SELECT CASE WHEN doc_id % 3 = 0 AND {STATUS_SQL} = 'failed' THEN 'retry_pending' WHEN doc_id % 7 = 0 THEN 'deleted' ELSE {STATUS_SQL} END AS status, count(*) AS n FROM docs GROUP BY 1")
def retried_states(spark, sf_dir):
    """States after removals of every seventh document and then requests to retry every third."""
    d = stated(spark, sf_dir)
    waiting = L.retried(d, d.where("doc_id % 3 = 0"))[0]
    return L.removed(waiting, d.where("doc_id % 7 = 0").join(waiting.where("status = 'retry_pending'").select("doc_id"), "doc_id", "left_anti")).groupBy("status").agg(F.count("*").alias("n"))


@query("guest_import", "WITH t AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 6 = 0 AND turn = 1 THEN ' ' ELSE text END AS text FROM conversations), b AS (SELECT DISTINCT conv_id FROM t WHERE role NOT IN ('user', 'assistant') OR trim(text) = '') SELECT conv_id, count(*) AS n FROM t WHERE conv_id NOT IN (SELECT conv_id FROM b) GROUP BY 1")
def guest_import(spark, sf_dir):
    """Conversations that may be imported, and their turns; one bad turn refuses the whole."""
    t = table(spark, sf_dir, "conversations").withColumn("text", F.when((F.col("conv_id") % 6 == 0) & (F.col("turn") == 1), " ").otherwise(F.col("text")))
    return L.imported(t)[0].groupBy("conv_id").agg(F.count("*").alias("n"))


@query("view_refresh", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents WHERE NOT (source IN ('src1', 'src2') AND doc_id % 2 = 0) GROUP BY 1")
def view_refresh(spark, sf_dir):
    """A view of all documents by source in which two sources, that have lost documents, are made anew."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    make = lambda rows: rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    left = d.where("NOT (source IN ('src1', 'src2') AND doc_id % 2 = 0)")
    return L.refreshed(make(d), left, spark.createDataFrame([("src1",), ("src2",)], "source string"), "source", make)


@query("table_chunks", "WITH RECURSIVE r AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, length(c_name) + length(c_mktsegment) + 5 AS s FROM customer), w(k, i, batch, n, size) AS (SELECT k, i, 0, 1, 16 + s FROM r WHERE i = 1 UNION ALL SELECT w.k, r.i, CASE WHEN w.size + r.s > 400 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.size + r.s > 400 THEN 1 ELSE w.n + 1 END, CASE WHEN w.size + r.s > 400 THEN 16 + r.s ELSE w.size + r.s END FROM w JOIN r ON r.k = w.k AND r.i = w.i + 1) SELECT k AS table_id, batch, CAST(max(n) AS BIGINT) AS n, CAST(max(size) AS BIGINT) AS size FROM w GROUP BY 1, 2")
def table_chunks(spark, sf_dir):
    """Tables of customers by nation in chunks of 400 characters, each with the heading again."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "table_id")
    return L.batches(c, ["table_id"], F.col("c_custkey"), F.length("c_name") + F.length("c_mktsegment") + 5, 16, 400)


@query("unique_checksums", WITH_DOCS + f"SELECT sha256(text) AS checksum, min(doc_id) AS doc_id FROM docs WHERE {STATUS_SQL} <> 'deleted' GROUP BY 1")
def unique_checksums(spark, sf_dir):
    """One document of each content, among those that are not deleted."""
    return documents(spark, sf_dir).where(status() != "deleted").groupBy(F.sha2("text", 256).alias("checksum")).agg(F.min("doc_id").alias("doc_id"))


@query("run_history", WITH_DOCS + ", r AS (SELECT doc_id % 12 AS run, max(updated_s) AS newest_s, round(avg(doc_id % 100) / 100.0::DOUBLE, 6) AS score FROM docs GROUP BY 1) SELECT run, score, CAST(row_number() OVER (ORDER BY newest_s DESC, run) AS INTEGER) AS newest, run = (SELECT arg_max(run, (score, -run)) FROM r) AS best FROM r")
def run_history(spark, sf_dir):
    """Runs appended to a history, newest first, and which of them is the best."""
    runs = documents(spark, sf_dir).groupBy((F.col("doc_id") % 12).alias("run")).agg(F.max("updated_s").alias("at"), F.round(F.avg(F.col("doc_id") % 100) / 100.0, 6).alias("score"))
    path = new_path(spark, "runs")
    for part in ("run < 6", "run >= 6"):
        runs.where(part).write.mode("append").parquet(path)
    held = spark.read.parquet(path)
    best = F.broadcast(held.agg(F.max_by("run", F.struct("score", -F.col("run"))).alias("best_run")))
    newest = T.ranked(held.withColumn("all", F.lit(0)), ["all"], [F.desc("at"), F.col("run")], 1000, "newest")  # a history is short
    return newest.join(best).select("run", "score", "newest", (F.col("run") == F.col("best_run")).alias("best"))


@query("golden_cases", r"WITH t AS (SELECT doc_id, source, concat(text, ' Effective Date: 2024-0', 1 + doc_id % 9, '-1', doc_id % 10, '. Contact: a', doc_id, '@x.org.') AS text FROM documents) SELECT doc_id, source, 'date' AS kind, regexp_extract(text, 'Effective Date: ([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS answer FROM t UNION ALL SELECT doc_id, source, 'contact', regexp_extract(text, 'Contact: ([a-z0-9]+@[a-z.]+[a-z])', 1) FROM t")
def golden_cases(spark, sf_dir):
    """Cases for evaluation: facts that a document states, as questions' answers."""
    d = F.col("doc_id")
    text = F.concat("text", F.lit(" Effective Date: 2024-0"), (d % 9 + 1).cast("string"), F.lit("-1"), (d % 10).cast("string"), F.lit(". Contact: a"), d.cast("string"), F.lit("@x.org."))
    rules = {"date": r"Effective Date: ([0-9]{4}-[0-9]{2}-[0-9]{2})", "contact": r"Contact: ([a-z0-9]+@[a-z.]+[a-z])"}
    facts = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract(text, p, 1).alias("answer")) for k, p in rules.items()])
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(facts).alias("f")).where("f.answer <> ''").select("doc_id", "source", "f.kind", "f.answer")


@query("required_indexes", PLAN_SQL + f", first AS (SELECT conversation_id, turn, arg_min(intent, (-confidence, ord)) AS intent FROM s GROUP BY 1, 2), a AS (SELECT conversation_id, turn, q, coalesce(intent, 'unknown') AS intent FROM questions LEFT JOIN first USING (conversation_id, turn)), i AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {p}, {chr(39)}{x}{chr(39)})' for k, xs in V.INTENT_INDEXES.items() for p, x in enumerate(xs))}) AS i(intent, place, index_name)), n AS (SELECT conversation_id, turn, place, index_name FROM a JOIN i USING (intent) UNION ALL SELECT conversation_id, turn, 10, 'version' FROM a WHERE regexp_matches(lower(q), '{V.LATEST}') OR regexp_matches(lower(q), '{V.OLDEST}') UNION ALL SELECT conversation_id, turn, 11, 'metadata' FROM a WHERE regexp_matches(lower(q), '{V.LATEST}') OR regexp_matches(lower(q), '{V.OLDEST}')), d AS (SELECT conversation_id, turn, index_name, min(place) AS place FROM n GROUP BY 1, 2, 3) SELECT conversation_id, turn, string_agg(index_name, ',' ORDER BY place) AS indexes FROM d GROUP BY 1, 2")
def required_indexes(spark, sf_dir):
    """The indexes that a plan for each question needs: by its first intent, and for the newest or oldest the versions."""
    return questions(spark, sf_dir).select("conversation_id", "turn", F.array_join(P.required_indexes(F.col("q")), ",").alias("indexes"))


DATED_SQL = QUESTIONS_SQL + ", dated AS (SELECT conversation_id, turn, lower(concat(q, [' before 2024-3-1', ' after 2023', ' in german', ' the most recent', ' language hindi before 1999/1/1'][1 + (conversation_id + turn) % 5])) AS q FROM questions) "


@query("query_constraints", DATED_SQL + f"SELECT conversation_id, turn, regexp_matches(q, '{V.LATEST}') AS latest, regexp_matches(q, '{V.OLDEST}') AS oldest, nullif(regexp_extract(q, '{V.BEFORE}', 1), '') AS before, nullif(regexp_extract(q, '{V.AFTER}', 1), '') AS after, nullif(regexp_extract(q, '{V.LANGUAGE}', 1), '') AS language FROM dated")
def query_constraints(spark, sf_dir):
    """Constraints on time and language that questions set."""
    tails = F.array(*[F.lit(x) for x in (" before 2024-3-1", " after 2023", " in german", " the most recent", " language hindi before 1999/1/1")])
    q = F.lower(F.concat("q", F.get(tails, ((F.col("conversation_id") + F.col("turn")) % 5).cast("int"))))
    found = lambda p: F.nullif(F.regexp_extract(q, p, 1), F.lit(""))
    return questions(spark, sf_dir).select("conversation_id", "turn", q.rlike(V.LATEST).alias("latest"), q.rlike(V.OLDEST).alias("oldest"), found(V.BEFORE).alias("before"), found(V.AFTER).alias("after"), found(V.LANGUAGE).alias("language"))


@query("focus_source", S.BM25_SQL + ", t AS (SELECT query, source, score FROM sparse JOIN documents ON doc_id = doc WHERE rank <= 10), f AS (SELECT query, source, round(sum(score), 4) AS total FROM t GROUP BY 1, 2) SELECT query, arg_max(source, (total, source)) AS source, max(total) AS total FROM f GROUP BY 1")
def focus_source(spark, sf_dir):
    """The source whose results among the ten best of a query score most together."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source")
    f = S.sparse(spark, sf_dir, 10).join(d, "doc").groupBy("query", "source").agg(F.round(F.sum("score"), 4).alias("total"))
    return f.groupBy("query").agg(F.max_by("source", F.struct("total", "source")).alias("source"), F.max("total").alias("total"))


@query("focus_supplement", S.BM25_SQL + ", t AS (SELECT query, source, score, doc FROM sparse JOIN documents ON doc_id = doc WHERE rank <= 10), f AS (SELECT query, source, round(sum(score), 4) AS total FROM t GROUP BY 1, 2), b AS (SELECT query, arg_max(source, (total, source)) AS source FROM f GROUP BY 1) SELECT query, count(*) AS n FROM b JOIN documents d USING (source) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.query = b.query AND t.doc = d.doc_id) GROUP BY 1")
def focus_supplement(spark, sf_dir):
    """How many further documents of its focus source each query may look at, besides those it has."""
    hits, d = S.sparse(spark, sf_dir, 10), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source")
    focus = focus_source(spark, sf_dir).select("query", "source")
    return focus.join(d, "source").join(hits.select("query", "doc"), ["query", "doc"], "left_anti").groupBy("query").agg(F.count("*").alias("n"))


@query("result_citations", S.BM25_SQL + ", t AS (SELECT query, doc, source, rank, text FROM sparse JOIN documents ON doc_id = doc WHERE rank <= 10), c AS (SELECT query, source, doc, CASE WHEN length(text) > 200 THEN concat(rtrim(text[1:200]), '...') ELSE text END AS excerpt, row_number() OVER (PARTITION BY query, source ORDER BY rank) AS r FROM t) SELECT query, source, doc, md5(excerpt) AS excerpt FROM c WHERE r = 1")
def result_citations(spark, sf_dir):
    """The first result of each source of a query, with an excerpt."""
    from lodestack.functions import text as X

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", X.excerpt(F.col("text"), 200).alias("excerpt"))
    first = T.ranked(S.sparse(spark, sf_dir, 10).join(d, "doc").withColumnRenamed("rank", "at"), ["query", "source"], [F.col("at")], 1)
    return first.select("query", "source", "doc", F.md5("excerpt").alias("excerpt"))


@query("explain_trace", S.FUSED_SQL + ", " + BONUS_SQL[len(S.BM25_SQL) :].lstrip().lstrip(",") + ", p AS (SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY final DESC, score DESC, doc) AS INTEGER) AS place FROM b) SELECT coalesce(f.query, p.query) AS query, coalesce(f.doc, p.doc) AS doc, dense_rank, sparse_rank, f.rank AS fused_rank, place AS rescored_rank, coalesce(f.rank <= 5, false) AS returned FROM final f FULL JOIN p ON p.query = f.query AND p.doc = f.doc")
def explain_trace(spark, sf_dir):
    """Where each document stood at every stage of a query: by vectors, by keywords, fused, and rescored."""
    f = S.fused(spark, sf_dir, 40).select("query", "doc", "dense_rank", "sparse_rank", F.col("rank").alias("fused_rank"))
    p = metadata_bonus(spark, sf_dir).select("query", "doc", F.col("place").alias("rescored_rank"))
    return f.join(p, ["query", "doc"], "full_outer").withColumn("returned", F.coalesce(F.col("fused_rank") <= 5, F.lit(False)))


@query("evidence_groups", WITH_DOCS + ", e AS (SELECT collection AS source, concat('Part ', doc_id % 6) AS heading, doc_id % 4 AS page, doc_id FROM docs) SELECT source, heading, count(*) AS n, min(page) AS first_page, arg_min(doc_id, (page, doc_id)) AS first_id FROM e GROUP BY 1, 2")
def evidence_groups(spark, sf_dir):
    """Evidence by source and heading: how much, and its first piece by page."""
    e = documents(spark, sf_dir).select(F.col("collection").alias("source"), F.concat(F.lit("Part "), (F.col("doc_id") % 6).cast("string")).alias("heading"), (F.col("doc_id") % 4).alias("page"), "doc_id")
    return e.groupBy("source", "heading").agg(F.count("*").alias("n"), F.min("page").alias("first_page"), F.min_by("doc_id", F.struct("page", "doc_id")).alias("first_id"))


@query("semantic_match", WITH_DOCS + ", c AS (SELECT doc_id, doc_id % 9 AS page, (doc_id * 5) % 9 AS expected, collection AS section, CASE WHEN doc_id % 2 = 0 THEN upper(collection) ELSE 'other part' END AS wanted, text FROM docs) SELECT doc_id, abs(page - expected) <= 1 AS page_match, contains(lower(section), lower(wanted)) OR contains(lower(wanted), lower(section)) AS section_match, contains(lower(text), lower(text[5:30])) AND doc_id % 5 > 0 AS content_match FROM c")
def semantic_match(spark, sf_dir):
    """Whether a result is at an expected page (one off counts), in an expected section, and holds an expected passage."""
    d = F.col("doc_id")
    page, expected = d % 9, (d * 5) % 9
    wanted, section = F.when(d % 2 == 0, F.upper("collection")).otherwise("other part"), F.col("collection")
    low = lambda x: F.lower(x)
    anchor = F.when(d % 5 > 0, F.substring("text", 5, 26))
    return documents(spark, sf_dir).select("doc_id", (F.abs(page - expected) <= 1).alias("page_match"), (F.contains(low(section), low(wanted)) | F.contains(low(wanted), low(section))).alias("section_match"), F.coalesce(F.contains(low(F.col("text")), low(anchor)), F.lit(False)).alias("content_match"))


@query("taxonomy_prefix_pairs", E.PATHS_SQL + ", p AS (SELECT path, count(*) AS n FROM (SELECT path FROM paths UNION ALL SELECT array_to_string(string_split(path, '/')[1:2], '/') FROM paths) GROUP BY 1) SELECT a.path AS path, b.path AS below, b.n FROM p a JOIN p b ON starts_with(b.path, concat(a.path, '/'))")
def taxonomy_prefix_pairs(spark, sf_dir):
    """Paths and the paths below them: each path meets its own prefixes, so no pair is tried that does not match."""
    # Texts are searched once; each path with its number stands for its documents from here on.
    paths = written(E.described(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n")), "paths")
    p = paths.unionByName(paths.select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("path"), "n")).groupBy("path").agg(F.sum("n").alias("n"))
    parts = F.split("path", "/")
    above = p.select(F.col("path").alias("below"), "n", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), lambda x: x != F.col("path"))).alias("path"))
    return above.join(p.select("path"), "path").select("path", "below", "n")


@query("shared_phrases", f"WITH {MESSAGES_SQL}, p AS (SELECT conversation_id, turn, lower(content) AS a, lower(lag(content) OVER (PARTITION BY conversation_id ORDER BY turn)) AS b FROM messages), q AS (SELECT conversation_id, turn, a, b, CASE WHEN turn % 4 = 1 THEN concat(a, ' ', b[10:40]) ELSE a END AS x FROM p WHERE b IS NOT NULL) SELECT conversation_id, turn, len(list_intersect(list_transform(range(1, greatest(1, length(x) - 16)), lambda i: x[i:i + 17]), list_transform(range(1, greatest(1, length(b) - 16)), lambda i: b[i:i + 17]))) > 0 AS shared FROM q")
def shared_phrases(spark, sf_dir):
    """Whether a message shares 18 characters in a row with the one before it."""
    from pyspark.sql.window import Window

    b = F.lower(F.lag("content").over(Window.partitionBy("conversation_id").orderBy("turn")))
    p = messages(spark, sf_dir).select("conversation_id", "turn", F.lower("content").alias("a"), b.alias("b")).where("b IS NOT NULL")
    p = p.withColumn("x", F.when(F.col("turn") % 4 == 1, F.concat_ws(" ", "a", F.substring("b", 10, 31))).otherwise(F.col("a")))
    return p.select("conversation_id", "turn", F.arrays_overlap(_runs("x"), _runs("b")).alias("shared"))


def _runs(c: str, n: int = 18):
    last = F.length(c) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(c), i + 1, F.lit(n)))).otherwise(F.array().cast("array<string>"))


@query("entity_flatten", "WITH e AS (SELECT doc_id, list_concat(regexp_extract_all(text, '[A-Z][a-z]{4,}'), regexp_extract_all(text, '[a-z]{12,}')) AS all_entities FROM documents), u AS (SELECT doc_id, unnest(all_entities) AS e FROM e) SELECT doc_id, count(DISTINCT lower(e)) AS n FROM u GROUP BY 1")
def entity_flatten(spark, sf_dir):
    """How many different entities several lists of a document name, without regard to case."""
    lists = F.concat(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), 0), F.regexp_extract_all("text", F.lit("[a-z]{12,}"), 0))
    n = F.size(F.array_distinct(F.transform(lists, F.lower))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).where("n > 0")


@query("question_coverage", E.ENTRIES_SQL + E.CONCEPTS_SQL + ", a AS (SELECT doc_id, concept FROM concepts WHERE doc_id % 2 = 0), q AS (SELECT doc_id + 1 AS doc_id, concept FROM a WHERE doc_id % 4 = 0 UNION SELECT doc_id, concept FROM a), k AS (SELECT q.doc_id, count(*) AS asked, count(c.concept) AS covered FROM q LEFT JOIN concepts c ON c.doc_id = q.doc_id AND c.concept = q.concept GROUP BY 1) SELECT doc_id, asked, covered, round(covered / asked, 6) AS share FROM k")
def question_coverage(spark, sf_dir):
    """How many of the concepts of a question its answer names."""
    c = E.entries(spark, sf_dir).select("doc_id", F.explode(K.concepts(F.col("text"))).alias("concept"))
    a = c.where("doc_id % 2 = 0")
    q = a.where("doc_id % 4 = 0").select((F.col("doc_id") + 1).alias("doc_id"), "concept").unionByName(a).distinct()
    k = q.join(c.withColumn("there", F.lit(1)), ["doc_id", "concept"], "left").groupBy("doc_id").agg(F.count("*").alias("asked"), F.count("there").alias("covered"))
    return k.withColumn("share", F.round(F.col("covered") / F.col("asked"), 6))


@query("reranked_results", BONUS_SQL + """, x AS (SELECT b.query, b.doc, b.bonus, b.score, CASE WHEN max(b.score) OVER w = min(b.score) OVER w THEN 1.0::DOUBLE ELSE round((b.score - min(b.score) OVER w) / (max(b.score) OVER w - min(b.score) OVER w), 4) END AS ce, (b.doc % 11) / 10.0::DOUBLE AS hybrid, length(d.text) AS n FROM b JOIN documents d ON doc_id = doc WINDOW w AS (PARTITION BY query)),
y AS (SELECT query, doc, CAST(round(CAST(0.55::DOUBLE * ce + 0.2::DOUBLE * least(1, hybrid) + 0.25::DOUBLE * least(1, greatest(0, bonus / 0.15::DOUBLE)) - 0.18::DOUBLE * CASE WHEN doc % 13 = 0 THEN 0.3::DOUBLE ELSE 0 END - 0.55::DOUBLE * CASE WHEN n <= 48 THEN 1 ELSE 0 END AS DECIMAL(18, 9)), 4) AS DOUBLE) AS score FROM x) SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS final_rank FROM y""")
def reranked_results(spark, sf_dir):
    """Keyword results by a blend of their scores, of another ranking and of their bonus, less penalties, with their final rank."""
    hits = S.sparse(spark, sf_dir, 20).select("query", "doc", "score").join(metadata_bonus(spark, sf_dir).select("query", "doc", "bonus"), ["query", "doc"])
    n = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.length("text").alias("n"))
    own = R.min_max(hits.join(n, "doc"), {"score": "ce"}, ["query"])
    contents = F.when(F.col("doc") % 13 == 0, 0.3).otherwise(0.0)
    score = P.blended(F.col("ce"), F.least(F.lit(1.0), (F.col("doc") % 11) / 10.0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("bonus") / 0.15)), contents, F.when(F.col("n") <= 48, 1.0).otherwise(0.0), F.lit(0.0))
    return T.ranked(own.select("query", "doc", score.alias("score")), ["query"], [F.desc("score"), F.col("doc")], 20, "final_rank")


@query("candidate_expansion", E.GRAPH_SQL + ", seeds AS (SELECT concat('doc:', doc_id) AS src FROM documents WHERE doc_id % 10 = 0) SELECT dst AS node, count(*) AS n, round(max(confidence), 6) AS confidence FROM best JOIN seeds USING (src) WHERE type <> 'contains_topic' AND dst NOT IN (SELECT src FROM seeds) GROUP BY 1")
def candidate_expansion(spark, sf_dir):
    """What candidates lead to by their edges, besides each other."""
    from lodestack.operators import graph as G

    seeds = table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("src"))
    best = G.best_edges(E.edges(spark, sf_dir)).where("type <> 'contains_topic'")
    out = best.join(seeds, "src", "left_semi").join(seeds.withColumnRenamed("src", "dst"), "dst", "left_anti")
    return out.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.round(F.max("confidence"), 6).alias("confidence"))
