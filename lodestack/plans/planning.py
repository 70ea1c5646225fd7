"""Question understanding and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.bindings import DOCS_SQL, MESSAGES_SQL, documents, messages
from lodestack.functions.fixed import CATEGORIES, LEGITIMATE, UNSAFE
from lodestack.operators import planning as P
from lodestack.operators import relational as R
from lodestack.operators.retrieval import ranked
from lodestack.plans.registry import query

#: Questions made from messages by adding one of some fixed openings.
OPENINGS = (
    "what is ", "how many ", "compare ", "list ", "and ", "the budget of ", "how do i hack someone's email with ", "security policy: ", "which document has ", "compare the security budgets of ",
    "what is the password policy for ", "the latest version of ", "who is ", "show me the table of ", "is it aml compliance when ", "what are the steps of ", "how many vpn users in hr have ", "",
)
_VALUES = ", ".join("'" + o.replace("'", "''") + "'" for o in OPENINGS)
QUESTIONS_SQL = f"""WITH {MESSAGES_SQL}, questions AS (SELECT conversation_id, turn, concat([{_VALUES}][1 + (conversation_id + turn) % {len(OPENINGS)}], content) AS q FROM messages WHERE role = 'user') """


CATEGORY_SQL = P.rules_sql("trim(q)", CATEGORIES, "general")
SAFETY_SQL = P.rules_sql("q", (("safe", (LEGITIMATE,)), ("unsafe", UNSAFE)), "safe")


def questions(spark, sf_dir):
    opening = F.get(F.array(*[F.lit(o) for o in OPENINGS]), ((F.col("conversation_id") + F.col("turn")) % len(OPENINGS)).cast("int"))
    return messages(spark, sf_dir).where("role = 'user'").select("conversation_id", "turn", F.concat(opening, "content").alias("q"))


@query("question_categories", QUESTIONS_SQL + f", c AS (SELECT {CATEGORY_SQL} AS category FROM questions) SELECT category, CASE category WHEN 'list' THEN 8 WHEN 'table' THEN 8 WHEN 'definition' THEN 12 ELSE 5 END AS context_size, count(*) AS n FROM c GROUP BY 1, 2")
def question_categories(spark, sf_dir):
    c = questions(spark, sf_dir).select(P.category(F.col("q")).alias("category"))
    return c.groupBy("category", P.context_size(F.col("category")).alias("context_size")).agg(F.count("*").alias("n"))


@query("question_safety", QUESTIONS_SQL + f"SELECT {SAFETY_SQL} AS safety, count(*) AS n FROM questions GROUP BY 1")
def question_safety(spark, sf_dir):
    return questions(spark, sf_dir).groupBy(P.safety(F.col("q")).alias("safety")).agg(F.count("*").alias("n"))


@query("question_routing", QUESTIONS_SQL + f""", o AS (SELECT *, {CATEGORY_SQL} AS category, {SAFETY_SQL} AS safety FROM questions), b AS (SELECT *, CASE WHEN category IN ('security', 'financial', 'policy', 'procedure', 'table', 'numeric') THEN 'document' ELSE 'general' END AS own FROM o),
l AS (SELECT *, lag(own) OVER (PARTITION BY conversation_id ORDER BY turn) AS before FROM b)
SELECT conversation_id, turn, CASE WHEN safety = 'unsafe' THEN 'unsafe' WHEN regexp_matches(q, '(?i){P.FOLLOW_UP}') AND before IS NOT NULL THEN before ELSE own END AS route FROM l""")
def question_routing(spark, sf_dir):
    own = F.when(P.category(F.col("q")).isin("security", "financial", "policy", "procedure", "table", "numeric"), "document").otherwise("general")
    before = F.lag("own").over(Window.partitionBy("conversation_id").orderBy("turn"))
    q = questions(spark, sf_dir).withColumn("own", own).withColumn("before", before)
    return q.select("conversation_id", "turn", P.route(F.col("q"), F.col("before"), F.lit(1)).alias("route"))


SCORED_SQL = f"WITH {DOCS_SQL}, scored AS (SELECT lang AS query, doc_id AS doc, round((file_size % 997) / 997.0::DOUBLE, 6) AS score FROM docs) "


def scored(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("lang").alias("query"), F.col("doc_id").alias("doc"), F.round((F.col("file_size") % 997) / 997.0, 6).alias("score"))


@query("evidence_tiers", SCORED_SQL + """, t AS (SELECT *, max(score) OVER (PARTITION BY query) AS top, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r FROM scored),
k AS (SELECT query, CASE WHEN score >= greatest(0.45::DOUBLE, top - 0.22::DOUBLE) OR r = 1 THEN 'primary' WHEN score >= greatest(0.25::DOUBLE, top - 0.45::DOUBLE) THEN 'supporting' ELSE 'optional' END AS tier FROM t)
SELECT query, tier, count(*) AS n FROM k GROUP BY 1, 2""")
def evidence_tiers(spark, sf_dir):
    return P.tiers(scored(spark, sf_dir), "query", "score", "doc").groupBy("query", "tier").agg(F.count("*").alias("n"))


@query("merged_variants", SCORED_SQL + """, v AS (SELECT query, variant, doc, row_number() OVER (PARTITION BY query, variant ORDER BY round(score * (1 + variant * (doc % 7) / 10.0::DOUBLE), 6) DESC, doc) AS rank FROM scored, (SELECT unnest([0, 1, 2]) AS variant)),
h AS (SELECT * FROM v WHERE rank <= 20), f AS (SELECT query, doc, sum(1 / (60 + rank)::DOUBLE) AS fused, min(CASE WHEN variant = 0 THEN rank END) AS own FROM h GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN own IS NOT NULL AND row_number() OVER (PARTITION BY query ORDER BY coalesce(own, 2147483647), doc) <= 5 THEN row_number() OVER (PARTITION BY query ORDER BY coalesce(own, 2147483647), doc) END AS reserved FROM f),
p AS (SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY coalesce(reserved, 2147483647), round(fused, 9) DESC, doc) AS INTEGER) AS position FROM s)
SELECT query, doc, position FROM p WHERE position <= 10""")
def merged_variants(spark, sf_dir):
    v = scored(spark, sf_dir).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(2))))
    moved = v.withColumn("s", F.round(F.col("score") * (1 + F.col("variant") * (F.col("doc") % 7) / 10.0), 6))
    return P.merged_variants(ranked(moved, ["query", "variant"], [F.desc("s"), F.col("doc")], 20), "query", "doc", 10)


@query("rerank_blend", f"""WITH {DOCS_SQL}, s AS (SELECT lang, doc_id, CAST(file_size % 997 AS DOUBLE) AS a, CAST(updated_s % 991 AS DOUBLE) AS b, (doc_id % 10) / 10.0::DOUBLE AS m, CASE WHEN regexp_matches(text, '\\|') THEN 1 ELSE 0 END AS toc, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 48 AND len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) <= 6 THEN 1 ELSE 0 END AS stub FROM docs),
n AS (SELECT *, CASE WHEN max(a) OVER w = min(a) OVER w THEN 1.0::DOUBLE ELSE round((a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w), 4) END AS na, CASE WHEN max(b) OVER w = min(b) OVER w THEN 1.0::DOUBLE ELSE round((b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w), 4) END AS nb FROM s WINDOW w AS (PARTITION BY lang))
SELECT lang, doc_id, round(round(0.55::DOUBLE * na + 0.2::DOUBLE * nb + 0.25::DOUBLE * m - 0.18::DOUBLE * toc - 0.55::DOUBLE * stub, 9), 3) AS score FROM n""")
def rerank_blend(spark, sf_dir):
    s = documents(spark, sf_dir).select("lang", "doc_id", (F.col("file_size") % 997).cast("double").alias("a"), (F.col("updated_s") % 991).cast("double").alias("b"), ((F.col("doc_id") % 10) / 10.0).alias("m"), F.col("text").rlike(r"\|").cast("int").alias("toc"), P.stub(F.col("text")).cast("int").alias("stub"))
    n = R.min_max(s, {"a": "na", "b": "nb"}, ["lang"])
    raw = 0.55 * F.col("na") + 0.2 * F.col("nb") + 0.25 * F.col("m") - 0.18 * F.col("toc") - 0.55 * F.col("stub")
    return n.select("lang", "doc_id", F.round(F.round(raw, 9), 3).alias("score"))


@query("multi_metric_ranking", f"""WITH {DOCS_SQL}, m AS (SELECT collection, round(avg(file_size), 6) AS size, count(*) AS n, max(updated_s) AS fresh FROM docs GROUP BY 1)
SELECT collection, CAST(row_number() OVER (ORDER BY size DESC, collection) AS INTEGER) AS by_size, CAST(row_number() OVER (ORDER BY n DESC, collection) AS INTEGER) AS by_count, CAST(row_number() OVER (ORDER BY fresh DESC, collection) AS INTEGER) AS by_freshness FROM m""")
def multi_metric_ranking(spark, sf_dir):
    """Several rankings of the collections, of which there are few."""
    m = documents(spark, sf_dir).groupBy("collection").agg(F.round(F.avg("file_size"), 6).alias("size"), F.count("*").alias("n"), F.max("updated_s").alias("fresh"))
    by = lambda c: F.row_number().over(Window.partitionBy().orderBy(F.desc(c), "collection"))
    return m.select("collection", by("size").alias("by_size"), by("n").alias("by_count"), by("fresh").alias("by_freshness"))


@query("best_run", f"""WITH {DOCS_SQL}, r AS (SELECT collection AS run, avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0 END) AS r1, avg(CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.5 END) AS mrr, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END) AS ans, avg(CASE WHEN visibility = 'public' THEN 1.0 ELSE 0 END) AS cit FROM docs GROUP BY 1),
s AS (SELECT run, round(0.35::DOUBLE * r1 + 0.25::DOUBLE * mrr + 0.25::DOUBLE * ans + 0.15::DOUBLE * cit, 6) AS score FROM r) SELECT run, score FROM s ORDER BY score DESC, run LIMIT 1""")
def best_run(spark, sf_dir):
    share = lambda cond, other=0.0: F.avg(F.when(cond, 1.0).otherwise(other))
    r = documents(spark, sf_dir).groupBy(F.col("collection").alias("run")).agg(share(F.col("doc_id") % 3 == 0).alias("r1"), share(F.col("doc_id") % 2 == 0, 0.5).alias("mrr"), share(F.col("lang") == "en").alias("ans"), share(F.col("visibility") == "public").alias("cit"))
    score = F.round(0.35 * F.col("r1") + 0.25 * F.col("mrr") + 0.25 * F.col("ans") + 0.15 * F.col("cit"), 6)
    return r.select("run", score.alias("score")).orderBy(F.desc("score"), "run").limit(1)


@query("failure_buckets", f"""WITH {DOCS_SQL}, b AS (SELECT doc_id, CASE WHEN length(text) < 100 THEN 'too_short' WHEN length(text) > 20000 THEN 'too_long' WHEN visibility = 'private' THEN 'denied' END AS label FROM docs)
SELECT label, doc_id, count(*) OVER (PARTITION BY label) AS n FROM b WHERE label IS NOT NULL""")
def failure_buckets(spark, sf_dir):
    """Failed cases by label with the size of their bucket; a row each, as a bucket may be of any size."""
    label = F.when(F.length("text") < 100, "too_short").when(F.length("text") > 20000, "too_long").when(F.col("visibility") == "private", "denied")
    b = documents(spark, sf_dir).select("doc_id", label.alias("label")).where("label IS NOT NULL")
    return b.join(F.broadcast(b.groupBy("label").agg(F.count("*").alias("n"))), "label")  # a row a label
