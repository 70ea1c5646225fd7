"""Activity reports: ranges of dates, access, failures, overviews, gaps, series and their values for print."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions import text as X
from lodestack.functions.bindings import AUDIT_SQL, DOCS_SQL, EPOCH, MESSAGES_SQL, audit_logs, documents, messages, users
from lodestack.functions.fixed import FILE_CATEGORIES, MASTHEAD, ROLE_CATEGORIES
from lodestack.operators import activity as A
from lodestack.operators import relational as R
from lodestack.plans.relational import CITED_SQL, citations
from lodestack.plans.registry import query
from lodestack.session import table

WITH_AUDIT = f"WITH {AUDIT_SQL} "
WITH_DOCS = f"WITH {DOCS_SQL} "
STATUS_SQL = "CASE doc_id % 10 WHEN 0 THEN 'deleted' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' ELSE 'indexed' END"
USERS_SQL = "users AS (SELECT c_custkey AS user_id, c_name AS name, c_acctbal > 0 AS is_active FROM customer)"


def status():
    k = F.col("doc_id") % 10
    return F.when(k == 0, "deleted").when(k == 1, "failed").when(k == 2, "processing").otherwise("indexed")


@query("preset_ranges", """WITH a AS (SELECT date_trunc('day', max(ts)) AS day FROM events), p AS (SELECT unnest([1, 7, 30, 90]) AS days), r AS (SELECT days, day - to_days(days - 1) AS first, day + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS last FROM a, p)
SELECT days, count(*) AS n, count(DISTINCT user_id) AS n_users FROM r JOIN events ON ts BETWEEN first AND last GROUP BY 1""")
def preset_ranges(spark, sf_dir):
    """Events of whole days back from the last one, for each preset number of days; ends are included."""
    e = table(spark, sf_dir, "events")
    day = F.broadcast(e.agg(F.date_trunc("day", F.max("ts")).alias("day")))  # one row
    presets = F.array(*[F.lit(d).cast("long") for d in A.PRESETS])
    held = e.join(day).withColumn("age", F.datediff(F.col("day"), F.to_date("ts"))).withColumn("days", F.explode(F.filter(presets, lambda d: F.col("age") < d)))
    return held.groupBy(F.col("days").cast("int").alias("days")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("documents_by_status", WITH_DOCS + f"SELECT {STATUS_SQL} AS status, count(*) AS n FROM docs WHERE {STATUS_SQL} NOT IN ('deleted', 'failed') GROUP BY 1")
def documents_by_status(spark, sf_dir):
    d = documents(spark, sf_dir).select(status().alias("status"))
    return d.where(~F.col("status").isin("deleted", "failed")).groupBy("status").agg(F.count("*").alias("n"))


@query("stale_documents", WITH_DOCS + f"SELECT count(*) AS n FROM docs WHERE {STATUS_SQL} NOT IN ('deleted', 'failed') AND updated_s < {EPOCH + 2592000} - 20 * 86400")
def stale_documents(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("status", status())
    return d.where(~F.col("status").isin("deleted", "failed") & (F.col("updated_s") < EPOCH + 2592000 - 20 * 86400)).agg(F.count("*").alias("n"))


@query("checksum_exists", "SELECT conv_id, turn, EXISTS (SELECT 1 FROM documents WHERE sha256(documents.text) = sha256(conversations.text)) AS known FROM conversations")
def checksum_exists(spark, sf_dir):
    """Whether a text is that of any document, by its checksum."""
    known = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("checksum")).distinct().withColumn("known", F.lit(True))
    c = table(spark, sf_dir, "conversations").withColumn("checksum", F.sha2("text", 256))
    return c.join(known, "checksum", "left").select("conv_id", "turn", F.coalesce("known", F.lit(False)).alias("known"))


CATEGORY_SQL = "CASE doc_id % 20 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FILE_CATEGORIES.values())) + " ELSE 'general' END"
ROLES_SQL = "(VALUES " + ", ".join(f"('{r}', '{c}')" for r, cs in ROLE_CATEGORIES.items() for c in cs) + ") AS a(role, category)"


@query("file_categories", WITH_DOCS + f"SELECT {CATEGORY_SQL} AS category, count(*) AS n FROM docs GROUP BY 1")
def file_categories(spark, sf_dir):
    """Documents by the category that their file's name stands for; other names are general."""
    names = F.array(*[F.lit(n) for n in FILE_CATEGORIES])
    stem = F.coalesce(F.get(names, (F.col("doc_id") % 20).cast("int")), F.lit("other"))
    return documents(spark, sf_dir).groupBy(R.file_category(F.concat(stem, F.lit(".txt"))).alias("category")).agg(F.count("*").alias("n"))


@query("category_access", WITH_DOCS + f"SELECT role, category, count(*) AS n FROM (SELECT {CATEGORY_SQL} AS category FROM docs) d JOIN {ROLES_SQL} USING (category) GROUP BY 1, 2")
def category_access(spark, sf_dir):
    """What each role may see, by category."""
    names = F.array(*[F.lit(n) for n in FILE_CATEGORIES])
    stem = F.coalesce(F.get(names, (F.col("doc_id") % 20).cast("int")), F.lit("other"))
    d = documents(spark, sf_dir).groupBy(R.file_category(F.concat(stem, F.lit(".txt"))).alias("category")).agg(F.count("*").alias("n"))
    allowed = spark.createDataFrame([(r, c) for r, cs in ROLE_CATEGORIES.items() for c in cs], "role string, category string")
    return d.join(F.broadcast(allowed), "category").select("role", "category", "n")


SEEN_SQL = "(owner_id = {u} OR visibility = 'public' OR (visibility = 'restricted' AND allowed_role IN ('hr', 'it')))"


@query("acl_sources", WITH_DOCS + f", asked AS (SELECT doc_id AS k, CASE WHEN doc_id % 9 = 0 THEN concat('gone_', doc_id, '.txt') ELSE filename END AS source FROM docs) SELECT DISTINCT source FROM asked JOIN docs ON source = filename WHERE {SEEN_SQL.format(u=7)}")
def acl_sources(spark, sf_dir):
    """Of the sources that a search names, those that are documents and granted; unknown ones are denied."""
    d = documents(spark, sf_dir)
    named = d.select(F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("gone_"), F.col("doc_id").cast("string"), F.lit(".txt"))).otherwise(F.col("filename")).alias("source"))
    return R.granted_sources(named, d, "source", "filename", seen(7)).select("source")


def seen(user: int):
    return R.visible(F.lit(False), F.lit(user), F.col("owner_id"), F.col("visibility"), F.array(F.lit("hr"), F.lit("it")), F.array("allowed_role"))


@query("acl_post_filter", WITH_DOCS + f", r AS (SELECT lang AS query, {SEEN_SQL.format(u=7)} AS ok FROM docs) SELECT query, count(*) AS candidates, count(*) FILTER (ok) AS authorized, count(*) FILTER (NOT ok) AS filtered FROM r GROUP BY 1")
def acl_post_filter(spark, sf_dir):
    """How many results of each query were found, granted and taken out."""
    r = documents(spark, sf_dir).select(F.col("lang").alias("query"), seen(7).alias("ok"))
    return r.groupBy("query").agg(F.count("*").alias("candidates"), F.count_if("ok").alias("authorized"), F.count_if(~F.col("ok")).alias("filtered"))


@query("acl_empty_set", WITH_DOCS + "SELECT 'none' AS allowed, count(*) AS n FROM docs WHERE false UNION ALL SELECT 'unset', count(*) FROM docs UNION ALL SELECT 'some', count(*) FROM docs WHERE collection IN ('src1', 'src3')")
def acl_empty_set(spark, sf_dir):
    """An empty set of allowed sources denies all; no set at all is no restriction."""
    d = documents(spark, sf_dir)
    parts = [d.where(R.in_allowed(F.col("collection"), allowed)).agg(F.count("*").alias("n")).select(F.lit(name).alias("allowed"), "n") for name, allowed in (("none", ()), ("unset", None), ("some", ("src1", "src3")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("acl_listing_page", WITH_DOCS + f", v AS (SELECT doc_id, filename, updated_s FROM docs WHERE {SEEN_SQL.format(u=7)}) SELECT doc_id, filename, (SELECT count(*) FROM v) AS total FROM v ORDER BY updated_s DESC, doc_id LIMIT 20 OFFSET 10")
def acl_listing_page(spark, sf_dir):
    """A page of the documents that a user may see, with their number; access comes before the page."""
    v = documents(spark, sf_dir).where(seen(7)).select("doc_id", "filename", "updated_s")
    total = F.broadcast(v.agg(F.count("*").alias("total")))  # one row
    return A.page(v, [F.desc("updated_s"), F.col("doc_id")], 10, 20).join(total).select("doc_id", "filename", "total")


@query("masthead_passages", rf"SELECT doc_id FROM (SELECT doc_id, trim(regexp_replace(concat(CASE WHEN doc_id % 3 = 0 THEN 'ACME Enterprise  Governance Policy ' ELSE '' END, text[1:200 + doc_id % 300]), '\s+', ' ', 'g')) AS t FROM documents) WHERE t <> '' AND len(string_split(t, ' ')) <= 45 AND regexp_matches(t, '(?i){MASTHEAD}')")
def masthead_passages(spark, sf_dir):
    """Short passages that only name a document."""
    head = F.when(F.col("doc_id") % 3 == 0, "ACME Enterprise  Governance Policy ").otherwise("")
    passage = F.concat(head, F.col("text").substr(F.lit(1), (F.lit(200) + F.col("doc_id") % 300).cast("int")))
    return table(spark, sf_dir, "documents").where(R.masthead(passage)).select("doc_id")


@query("clean_sentences", r"WITH s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'))) AS s FROM documents) SELECT doc_id, count(*) AS n, count(*) FILTER (length(s) BETWEEN 15 AND 600 AND NOT regexp_matches(s, '=+|-{4,}|_{4,}') AND regexp_matches(s, '[a-zA-Z]{3,}')) AS n_clean FROM s WHERE s <> '' GROUP BY 1")
def clean_sentences(spark, sf_dir):
    """Sentences that are usable prose: 15 to 600 characters, no rules, a word of three letters."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(X.clean_sentence(F.col("s"))).alias("n_clean"))


@query("citation_days", CITED_SQL + f", m AS (SELECT DISTINCT conversation_id, turn FROM cited) SELECT CAST(to_timestamp(created_s) AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS n FROM m JOIN messages USING (conversation_id, turn) GROUP BY 1".replace("to_timestamp(created_s) AT TIME ZONE 'UTC'", f"TIMESTAMP '2024-01-01' + to_seconds(created_s - {EPOCH})"))
def citation_days(spark, sf_dir):
    """Answers with citations by day."""
    m = messages(spark, sf_dir).join(citations(spark, sf_dir).select("conversation_id", "turn").distinct(), ["conversation_id", "turn"], "left_semi")
    return m.groupBy(F.to_date(F.timestamp_seconds("created_s")).alias("day")).agg(F.count("*").alias("n"))


@query("search_and_upload_days", WITH_AUDIT + "SELECT CAST(created_at AS DATE) AS day, count(*) FILTER (event_type = 'chat.question.asked') AS searches, count(*) FILTER (event_type = 'document.uploaded') AS uploads FROM audit WHERE event_type IN ('chat.question.asked', 'document.uploaded') GROUP BY 1")
def search_and_upload_days(spark, sf_dir):
    log = audit_logs(spark, sf_dir).where(F.col("event_type").isin("chat.question.asked", "document.uploaded"))
    return A.daily(log, "created_at", F.count_if(F.col("event_type") == "chat.question.asked").alias("searches"), F.count_if(F.col("event_type") == "document.uploaded").alias("uploads"))


@query("registration_days", f"WITH {AUDIT_SQL}, f AS (SELECT user_id, min(created_at) AS first FROM audit WHERE user_id IS NOT NULL GROUP BY 1) SELECT CAST(first AS DATE) AS day, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS active FROM f JOIN customer ON c_custkey = user_id GROUP BY 1")
def registration_days(spark, sf_dir):
    """First days of users, and how many of these accounts are active."""
    first = audit_logs(spark, sf_dir).where("user_id IS NOT NULL").groupBy("user_id").agg(F.min("created_at").alias("first"))
    return first.join(users(spark, sf_dir), "user_id").groupBy(F.to_date("first").alias("day")).agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"))


@query("names_without_case", WITH_DOCS + ", a AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN upper(collection) ELSE collection END AS name FROM docs) SELECT lower(name) AS folded, count(*) AS spellings, min(name) AS kept FROM a GROUP BY 1")
def names_without_case(spark, sf_dir):
    """Names that differ in case only are one; the first spelling stays."""
    a = documents(spark, sf_dir).select(F.when(F.col("doc_id") % 2 == 0, F.upper("collection")).otherwise(F.col("collection")).alias("name")).distinct()
    return a.groupBy(F.lower("name").alias("folded")).agg(F.count("*").alias("spellings"), F.min("name").alias("kept"))


@query("conversations_page", f"WITH {MESSAGES_SQL}, c AS (SELECT conversation_id, max(created_s) AS updated_s, count(*) AS n FROM messages WHERE conversation_id % 5 = 2 GROUP BY 1) SELECT conversation_id, n, (SELECT count(*) FROM c) AS total FROM c ORDER BY updated_s DESC, conversation_id LIMIT 10 OFFSET 5")
def conversations_page(spark, sf_dir):
    """A page of one user's conversations, newest first, with their number."""
    c = messages(spark, sf_dir).where("conversation_id % 5 = 2").groupBy("conversation_id").agg(F.max("created_s").alias("updated_s"), F.count("*").alias("n"))
    return A.page(c, [F.desc("updated_s"), F.col("conversation_id")], 5, 10).join(F.broadcast(c.agg(F.count("*").alias("total")))).select("conversation_id", "n", "total")


@query("message_history", f"WITH {MESSAGES_SQL} SELECT conversation_id, turn, role, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY created_s, turn) AS INTEGER) AS place FROM messages")
def message_history(spark, sf_dir):
    """All messages of each conversation in the order of their time."""
    return messages(spark, sf_dir).select("conversation_id", "turn", "role", F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_s", "turn")).alias("place"))


@query("authentication_failures", WITH_AUDIT + ", f AS (SELECT CASE WHEN k % 3 = 0 THEN NULL ELSE concat('login.', k % 4) END AS action FROM audit WHERE event_category = 'AUTH') SELECT coalesce(action, 'auth.login.failed') AS label, count(*) AS n, 'AUTH' AS category FROM f GROUP BY 1")
def authentication_failures(spark, sf_dir):
    f = audit_logs(spark, sf_dir).where("event_category = 'AUTH'").select(F.when(F.col("k") % 3 > 0, F.concat(F.lit("login."), (F.col("k") % 4).cast("string"))).alias("action"))
    return f.groupBy(F.coalesce("action", F.lit("auth.login.failed")).alias("label")).agg(F.count("*").alias("n")).withColumn("category", F.lit("AUTH"))


@query("upload_failures", WITH_DOCS + f"SELECT filename AS label, CAST(1 AS BIGINT) AS n, 'DOCUMENT' AS category, CAST(row_number() OVER (ORDER BY updated_s DESC, doc_id) AS INTEGER) AS place FROM docs WHERE {STATUS_SQL} = 'failed' ORDER BY updated_s DESC, doc_id LIMIT 25")
def upload_failures(spark, sf_dir):
    """The newest failed documents, a row each; a page of 25."""
    newest = A.page(documents(spark, sf_dir).where(status() == "failed"), [F.desc("updated_s"), F.col("doc_id")], 0, 25)  # then few enough to number
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("updated_s"), "doc_id"))
    return newest.select(F.col("filename").alias("label"), F.lit(1).cast("long").alias("n"), F.lit("DOCUMENT").alias("category"), place.alias("place"))


@query("error_counts", WITH_AUDIT + f", {DOCS_SQL} SELECT count(*) FILTER (event_type IN ('chat.retrieval.failed', 'document.uploaded', 'auth.login.success') AND k % 7 = 0) AS authorization_failures, (SELECT count(*) FROM docs WHERE {STATUS_SQL} = 'failed') AS upload_failures, (SELECT count(*) FROM docs WHERE {STATUS_SQL} = 'failed') AS indexing_failures, count(*) FILTER (event_type = 'chat.retrieval.failed') AS retrieval_failures, CAST(NULL AS BIGINT) AS api_errors, CAST(NULL AS BIGINT) AS background_failures FROM audit")
def error_counts(spark, sf_dir):
    """Failures by kind. Uploads and indexing fail by the documents' status; two kinds are not recorded and stay null."""
    denied = F.col("event_type").isin("chat.retrieval.failed", "document.uploaded", "auth.login.success") & (F.col("k") % 7 == 0)
    log = audit_logs(spark, sf_dir).agg(F.count_if(denied).alias("authorization_failures"), F.count_if(F.col("event_type") == "chat.retrieval.failed").alias("retrieval_failures"))
    failed = documents(spark, sf_dir).agg(F.count_if(status() == "failed").alias("upload_failures"))
    none = F.lit(None).cast("long")
    return log.join(F.broadcast(failed)).select("authorization_failures", "upload_failures", F.col("upload_failures").alias("indexing_failures"), "retrieval_failures", none.alias("api_errors"), none.alias("background_failures"))


@query("daily_citation_usage", WITH_AUDIT + "SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM audit WHERE event_type = 'chat.answer.generated' AND k % 5 > 0 GROUP BY 1")
def daily_citation_usage(spark, sf_dir):
    log = audit_logs(spark, sf_dir).where("event_type = 'chat.answer.generated' AND k % 5 > 0")
    return A.daily(log, "created_at", F.count("*").alias("n"))


@query("chat_snapshot", WITH_AUDIT + "SELECT count(*) FILTER (event_type = 'chat.question.asked') AS asked, count(*) FILTER (event_type = 'chat.answer.generated') AS answered, count(*) FILTER (event_type = 'chat.retrieval.failed') AS failed, round(avg(value) FILTER (event_type = 'chat.answer.generated'), 6) AS mean_value, round(avg(k % 5) FILTER (event_type = 'chat.answer.generated'), 6) AS mean_citations FROM audit")
def chat_snapshot(spark, sf_dir):
    of = lambda t: F.col("event_type") == t
    answers = of("chat.answer.generated")
    return audit_logs(spark, sf_dir).agg(
        F.count_if(of("chat.question.asked")).alias("asked"), F.count_if(answers).alias("answered"), F.count_if(of("chat.retrieval.failed")).alias("failed"),
        F.round(F.avg(F.when(answers, F.col("value"))), 6).alias("mean_value"), F.round(F.avg(F.when(answers, F.col("k") % 5)), 6).alias("mean_citations"),
    )


OVERVIEW_SQL = CITED_SQL + f""", files AS (SELECT *, {STATUS_SQL} AS status FROM docs), used AS (SELECT DISTINCT source FROM cited)
SELECT count(*) FILTER (status NOT IN ('deleted', 'failed')) AS active, count(*) FILTER (collection NOT IN (SELECT source FROM used)) AS unused, count(DISTINCT collection) AS collections, (SELECT count(*) FROM cited) AS citations,
  round((SELECT count(*) FROM cited) / (SELECT count(*) FROM used), 6) AS citations_per_source, count(*) FILTER (updated_s < {EPOCH} + 864000) AS stale FROM files"""


@query("knowledge_overview", OVERVIEW_SQL)
def knowledge_overview(spark, sf_dir):
    """Figures about documents and their use in one row."""
    used = citations(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    d = documents(spark, sf_dir).withColumn("status", status()).join(used, F.col("collection") == F.col("source"), "left")
    own = d.agg(F.count_if(~F.col("status").isin("deleted", "failed")).alias("active"), F.count_if(F.col("source").isNull()).alias("unused"), F.countDistinct("collection").alias("collections"), F.count_if(F.col("updated_s") < EPOCH + 864000).alias("stale"))
    cited = used.agg(F.sum("n").alias("citations"), F.round(F.sum("n") / F.count("*"), 6).alias("citations_per_source"))
    return own.join(F.broadcast(cited)).select("active", "unused", "collections", "citations", "citations_per_source", "stale")


@query("knowledge_gaps", WITH_AUDIT + f""", {DOCS_SQL}, {MESSAGES_SQL}, cited AS (SELECT conversation_id, turn, pos, concat('src', (conversation_id + turn * pos) % 23) AS source FROM messages, (SELECT unnest([1, 2]) AS pos) WHERE role = 'assistant' AND pos <= 1 + turn % 2),
none AS (SELECT 'questions_without_documents' AS category, 'Questions with no retrieved documents' AS label, count(*) AS n FROM audit WHERE event_type = 'chat.retrieval.failed'),
failed AS (SELECT 'failed_search' AS category, concat('reason-', k % 7) AS label, count(*) AS n FROM audit WHERE event_type = 'chat.retrieval.failed' GROUP BY 2 ORDER BY n DESC, label LIMIT 5),
never AS (SELECT 'never_cited_document' AS category, filename AS label, CAST(0 AS BIGINT) AS n FROM docs WHERE collection NOT IN (SELECT source FROM cited) ORDER BY filename LIMIT 5),
low AS (SELECT 'low_engagement_collection' AS category, collection AS label, count(source) AS n FROM (SELECT DISTINCT collection FROM docs) LEFT JOIN cited ON source = collection GROUP BY 2 ORDER BY n, label LIMIT 5)
SELECT * FROM none WHERE n > 0 UNION ALL SELECT * FROM failed UNION ALL SELECT * FROM never UNION ALL SELECT * FROM low""")
def knowledge_gaps(spark, sf_dir):
    """What questions did not find and what nobody used: a labelled union of the first five of each kind."""
    log = audit_logs(spark, sf_dir).where("event_type = 'chat.retrieval.failed'")
    d, c = documents(spark, sf_dir), citations(spark, sf_dir)
    kind = lambda df, name, label, n, *order: df.select(F.lit(name).alias("category"), label.alias("label"), n.alias("n")).orderBy(*order).limit(5)
    none = log.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("questions_without_documents").alias("category"), F.lit("Questions with no retrieved documents").alias("label"), "n")
    failed = kind(log.groupBy(F.concat(F.lit("reason-"), (F.col("k") % 7).cast("string")).alias("r")).agg(F.count("*").alias("c")), "failed_search", F.col("r"), F.col("c"), F.desc("n"), "label")
    unused = d.join(c.select("source").distinct(), F.col("collection") == F.col("source"), "left_anti")
    never = kind(unused, "never_cited_document", F.col("filename"), F.lit(0).cast("long"), "label")
    usage = d.select("collection").distinct().join(c.groupBy("source").agg(F.count("*").alias("c")), F.col("collection") == F.col("source"), "left")
    low = kind(usage, "low_engagement_collection", F.col("collection"), F.coalesce("c", F.lit(0)), "n", "label")
    return none.unionByName(failed).unionByName(never).unionByName(low)


@query("dashboard_overview", f"WITH {AUDIT_SQL}, {DOCS_SQL}, {USERS_SQL}, a AS (SELECT max(created_at) AS anchor FROM audit) SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM docs) AS documents, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, count(*) FILTER (event_type = 'chat.question.asked') AS asked, count(*) FILTER (event_category = 'AUTH') AS logins, count(*) AS events FROM audit, a WHERE created_at >= anchor - INTERVAL 7 DAY")
def dashboard_overview(spark, sf_dir):
    """Inventory, and the activity of the last seven days, in one row."""
    log = audit_logs(spark, sf_dir)
    anchor = F.broadcast(log.agg(F.max("created_at").alias("anchor")))
    week = log.join(anchor).where(F.col("created_at") >= F.col("anchor") - F.expr("INTERVAL 7 DAYS"))
    activity = week.agg(F.count_if(F.col("event_type") == "chat.question.asked").alias("asked"), F.count_if(F.col("event_category") == "AUTH").alias("logins"), F.count("*").alias("events"))
    one = lambda df, name, what: F.broadcast(df.agg(what.alias(name)))
    stock = one(users(spark, sf_dir), "users", F.count("*")).join(one(documents(spark, sf_dir), "documents", F.count("*"))).join(one(messages(spark, sf_dir), "conversations", F.countDistinct("conversation_id")))
    return stock.join(activity).select("users", "documents", "conversations", "asked", "logins", "events")


@query("monitoring_today", f"WITH {AUDIT_SQL}, {USERS_SQL}, d AS (SELECT date_trunc('day', max(created_at)) AS day FROM audit) SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM users WHERE is_active) AS active_users, (SELECT count(*) FROM documents) AS documents, count(*) FILTER (event_type = 'chat.question.asked') AS questions, count(*) FILTER (event_category = 'AUTH') AS logins, count(*) AS events FROM audit, d WHERE created_at >= day")
def monitoring_today(spark, sf_dir):
    """Activity since the start of the last day, and inventory."""
    log = audit_logs(spark, sf_dir)
    day = F.broadcast(log.agg(F.date_trunc("day", F.max("created_at")).alias("day")))
    today = log.join(day).where(F.col("created_at") >= F.col("day")).agg(F.count_if(F.col("event_type") == "chat.question.asked").alias("questions"), F.count_if(F.col("event_category") == "AUTH").alias("logins"), F.count("*").alias("events"))
    stock = users(spark, sf_dir).agg(F.count("*").alias("users"), F.count_if("is_active").alias("active_users")).join(F.broadcast(documents(spark, sf_dir).agg(F.count("*").alias("documents"))))
    return stock.join(F.broadcast(today)).select("users", "active_users", "documents", "questions", "logins", "events")


@query("workspace_summary", f"WITH {AUDIT_SQL}, {DOCS_SQL}, {MESSAGES_SQL}, v AS (SELECT owner_id AS user_id, count(*) AS own_documents FROM docs GROUP BY 1), c AS (SELECT conversation_id % 150 AS user_id, count(DISTINCT conversation_id) AS conversations FROM messages GROUP BY 1), q AS (SELECT user_id, count(*) AS questions FROM audit WHERE event_type = 'chat.question.asked' GROUP BY 1) SELECT c_custkey AS user_id, coalesce(own_documents, 0) AS own_documents, coalesce(conversations, 0) AS conversations, coalesce(questions, 0) AS questions FROM customer LEFT JOIN v ON v.user_id = c_custkey LEFT JOIN c ON c.user_id = c_custkey LEFT JOIN q ON q.user_id = c_custkey WHERE c_custkey < 150")
def workspace_summary(spark, sf_dir):
    """Documents, conversations and questions of each user."""
    u = users(spark, sf_dir).where("user_id < 150").select("user_id")
    v = documents(spark, sf_dir).groupBy(F.col("owner_id").alias("user_id")).agg(F.count("*").alias("own_documents"))
    c = messages(spark, sf_dir).groupBy((F.col("conversation_id") % 150).alias("user_id")).agg(F.countDistinct("conversation_id").alias("conversations"))
    q = audit_logs(spark, sf_dir).where("event_type = 'chat.question.asked'").groupBy("user_id").agg(F.count("*").alias("questions"))
    return u.join(v, "user_id", "left").join(c, "user_id", "left").join(q, "user_id", "left").na.fill(0)


@query("resource_metrics", WITH_DOCS + "SELECT count(*) AS documents, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS stored_bytes, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM conversations) AS messages FROM docs")
def resource_metrics(spark, sf_dir):
    n = lambda name, alias: F.broadcast(table(spark, sf_dir, name).agg(F.count("*").alias(alias)))
    return documents(spark, sf_dir).agg(F.count("*").alias("documents"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("stored_bytes")).join(n("embeddings", "vectors")).join(n("conversations", "messages"))


@query("health_events", WITH_AUDIT + "SELECT id, CASE WHEN event_type LIKE 'auth.%' THEN 'authentication' WHEN event_type LIKE 'chat.%' THEN 'chat' WHEN event_type LIKE 'document.%' THEN 'documents' ELSE 'system' END AS service, CASE WHEN status = 'failed' THEN 'degraded' ELSE 'healthy' END AS health, CASE WHEN status = 'failed' THEN concat(event_type, ': reason-', k % 7) ELSE event_type END AS detail FROM audit ORDER BY created_at DESC, id LIMIT 50 OFFSET 10")
def health_events(spark, sf_dir):
    """A page of the newest events as reports of the services' health."""
    page = A.page(audit_logs(spark, sf_dir), [F.desc("created_at"), F.col("id")], 10, 50)
    failed = F.col("status") == "failed"
    detail = F.concat_ws(": ", "event_type", F.when(failed, F.concat(F.lit("reason-"), (F.col("k") % 7).cast("string"))))
    return page.select("id", A.service(F.col("event_type"), F.col("event_category"), "system").alias("service"), F.when(failed, "degraded").otherwise("healthy").alias("health"), detail.alias("detail"))


@query("most_viewed_documents", CITED_SQL + ", v AS (SELECT source AS name, count(*) AS views FROM cited GROUP BY 1) SELECT name, views, CAST(row_number() OVER (ORDER BY views DESC, lower(name) DESC) AS INTEGER) AS place FROM v ORDER BY place LIMIT 10")
def most_viewed_documents(spark, sf_dir):
    """The most cited sources; equal ones in falling order of their names."""
    v = citations(spark, sf_dir).groupBy(F.col("source").alias("name")).agg(F.count("*").alias("views"))
    top = A.page(v, [F.desc("views"), F.desc(F.lower("name"))], 0, 10)
    return top.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("views"), F.desc(F.lower("name")))))  # ten rows


@query("least_viewed_documents", CITED_SQL + ", v AS (SELECT source, count(*) AS c FROM cited GROUP BY 1), s AS (SELECT DISTINCT collection AS name FROM docs) SELECT name, coalesce(c, 0) AS views FROM s LEFT JOIN v ON source = name ORDER BY views, lower(name) LIMIT 10")
def least_viewed_documents(spark, sf_dir):
    """The least cited sources, those that nobody cites first."""
    v = citations(spark, sf_dir).groupBy("source").agg(F.count("*").alias("c"))
    s = documents(spark, sf_dir).select(F.col("collection").alias("name")).distinct()
    return A.page(s.join(v, F.col("source") == F.col("name"), "left").select("name", F.coalesce("c", F.lit(0)).alias("views")), [F.col("views"), F.lower("name")], 0, 10)


@query("collection_ranking_page", CITED_SQL + ", u AS (SELECT collection, count(*) AS documents FROM docs GROUP BY 1), c AS (SELECT source, count(*) AS n FROM cited GROUP BY 1) SELECT collection, documents, coalesce(n, 0) AS usage FROM u LEFT JOIN c ON source = collection ORDER BY usage DESC, collection LIMIT 7 OFFSET 3")
def collection_ranking_page(spark, sf_dir):
    u = documents(spark, sf_dir).groupBy("collection").agg(F.count("*").alias("documents"))
    c = citations(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return A.page(u.join(c, F.col("source") == F.col("collection"), "left").select("collection", "documents", F.coalesce("n", F.lit(0)).alias("usage")), [F.desc("usage"), F.col("collection")], 3, 7)


@query("low_engagement_collections", CITED_SQL + ", u AS (SELECT collection, count(*) AS documents FROM docs GROUP BY 1), c AS (SELECT source, count(*) AS n FROM cited GROUP BY 1) SELECT collection, documents, coalesce(n, 0) AS usage FROM u LEFT JOIN c ON source = collection ORDER BY usage, documents, collection LIMIT 5")
def low_engagement_collections(spark, sf_dir):
    u = documents(spark, sf_dir).groupBy("collection").agg(F.count("*").alias("documents"))
    c = citations(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return A.page(u.join(c, F.col("source") == F.col("collection"), "left").select("collection", "documents", F.coalesce("n", F.lit(0)).alias("usage")), [F.col("usage"), F.col("documents"), F.col("collection")], 0, 5)


@query("worst_cases", WITH_DOCS + ", s AS (SELECT doc_id, 1.0::DOUBLE / (1 + doc_id % 5) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS score FROM docs) SELECT doc_id, round(score, 6) AS score FROM s ORDER BY score, doc_id LIMIT 5")
def worst_cases(spark, sf_dir):
    """The five cases with the least of reciprocal rank, answer and citation together."""
    score = 1.0 / (1 + F.col("doc_id") % 5) + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0) + F.when(F.col("lang") == "en", 1).otherwise(0)
    return documents(spark, sf_dir).select("doc_id", F.round(score, 6).alias("score")).orderBy("score", "doc_id").limit(5)


@query("domain_documents", WITH_DOCS + "SELECT doc_id % 8 AS domain_id, count(*) AS n FROM docs WHERE doc_id % 9 > 0 GROUP BY 1")
def domain_documents(spark, sf_dir):
    return documents(spark, sf_dir).where("doc_id % 9 > 0").groupBy((F.col("doc_id") % 8).alias("domain_id")).agg(F.count("*").alias("n"))


@query("provider_metrics", WITH_AUDIT + "SELECT event_type AS provider, count(*) AS calls, count(*) FILTER (status = 'failed') AS failures, round(avg(value), 6) AS mean_latency, round(max(value), 6) AS longest FROM audit GROUP BY 1")
def provider_metrics(spark, sf_dir):
    return audit_logs(spark, sf_dir).groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "failed").alias("failures"), F.round(F.avg("value"), 6).alias("mean_latency"), F.round(F.max("value"), 6).alias("longest"))


@query("report_sections", WITH_AUDIT + f""", {DOCS_SQL}, k AS (SELECT 'kpi' AS section, 'total_events' AS label, CAST(count(*) AS VARCHAR) AS value FROM audit UNION ALL SELECT 'kpi', 'mean_value', printf('%.2f', avg(value)) FROM audit UNION ALL SELECT 'kpi', 'has_failures', CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'Yes' ELSE 'No' END FROM audit UNION ALL SELECT 'kpi', 'api_errors', 'N/A'),
t AS (SELECT 'table', collection, CAST(count(*) AS VARCHAR) FROM docs GROUP BY 2), d AS (SELECT 'trend', CAST(CAST(created_at AS DATE) AS VARCHAR), CAST(count(*) AS VARCHAR) FROM audit GROUP BY 2), a AS (SELECT * FROM k UNION ALL SELECT * FROM t UNION ALL SELECT * FROM d)
SELECT section, CASE WHEN section = 'kpi' THEN array_to_string(list_transform(string_split(label, '_'), lambda x: concat(upper(x[1]), x[2:])), ' ') ELSE label END AS label, value FROM a""")
def report_sections(spark, sf_dir):
    """A report's figures, table and series as rows of labels and printed values."""
    log = audit_logs(spark, sf_dir)
    one = log.agg(F.count("*").alias("total_events"), F.avg("value").alias("mean_value"), (F.count_if(F.col("status") == "failed") > 0).alias("has_failures"), F.lit(None).cast("long").alias("api_errors"))
    shown = one.select(*[A.printed(F.col(c), t).alias(c) for c, t in one.dtypes])
    kpi = shown.unpivot([], shown.columns, "label", "value").select(F.lit("kpi").alias("section"), A.humanised(F.col("label")).alias("label"), "value")
    tab = documents(spark, sf_dir).groupBy("collection").agg(F.count("*").alias("n")).select(F.lit("table").alias("section"), F.col("collection").alias("label"), A.printed(F.col("n"), "bigint").alias("value"))
    trend = A.daily(log, "created_at", F.count("*").alias("n")).select(F.lit("trend").alias("section"), F.col("day").cast("string").alias("label"), A.printed(F.col("n"), "bigint").alias("value"))
    return kpi.unionByName(tab).unionByName(trend)


_FOLD = X.folded_sql


@query("match_modes", f"WITH {MESSAGES_SQL}, p AS (SELECT trim(content) AS actual, trim(CASE (conversation_id + turn) % 4 WHEN 0 THEN content WHEN 1 THEN upper(content) WHEN 2 THEN substr(content, 4, 20) ELSE 'no such answer' END) AS expected FROM messages) SELECT count(*) FILTER (actual = expected) AS exact, count(*) FILTER ({_FOLD('actual')} = {_FOLD('expected')}) AS case_insensitive, count(*) FILTER (contains({_FOLD('actual')}, {_FOLD('expected')})) AS contains_it, CAST(0 AS BIGINT) AS semantic FROM p")
def match_modes(spark, sf_dir):
    """How many answers match the expected one, exactly, without case, as a part; the semantic mode needs a judge and passes none."""
    k, c = (F.col("conversation_id") + F.col("turn")) % 4, F.col("content")
    expected = F.when(k == 0, c).when(k == 1, F.upper(c)).when(k == 2, F.substring(c, 4, 20)).otherwise("no such answer")
    p = messages(spark, sf_dir).select(F.trim(c).alias("a"), F.trim(expected).alias("e"))
    low = lambda x: X.folded(F.col(x))
    return p.agg(F.count_if(F.col("a") == F.col("e")).alias("exact"), F.count_if(low("a") == low("e")).alias("case_insensitive"), F.count_if(F.contains(low("a"), low("e"))).alias("contains_it"), F.lit(0).cast("long").alias("semantic"))


@query("suffix_numbers", WITH_DOCS + ", c AS (SELECT CASE doc_id % 3 WHEN 0 THEN concat(filename, '::', doc_id % 50) WHEN 1 THEN concat(filename, '::x') ELSE filename END AS id FROM docs) SELECT id, CASE WHEN contains(id, '::') THEN TRY_CAST(string_split(id, '::')[-1] AS INTEGER) END AS number FROM c")
def suffix_numbers(spark, sf_dir):
    """The number behind the last double colon of an id, if it is one."""
    k, name = F.col("doc_id") % 3, F.col("filename")
    own = F.when(k == 0, F.concat(name, F.lit("::"), (F.col("doc_id") % 50).cast("string"))).when(k == 1, F.concat(name, F.lit("::x"))).otherwise(name)
    return documents(spark, sf_dir).select(own.alias("id")).select("id", X.suffix_number(F.col("id")).alias("number"))


@query("json_columns", "WITH j AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('[\"a', event_id % 5, '\", \"b\"]') WHEN 1 THEN '[broken' WHEN 2 THEN NULL ELSE '[]' END AS roles, CASE event_id % 3 WHEN 0 THEN '{\"n\": 2.5}' WHEN 1 THEN '{\"n\": true}' ELSE '{\"n\": \"7\"}' END AS meta FROM events) SELECT event_id % 4 AS kind, event_id % 3 AS meta_kind, count(*) AS n, CAST(sum(CASE WHEN json_valid(roles) THEN coalesce(json_array_length(roles), 0) ELSE 0 END) AS BIGINT) AS n_roles, CAST(sum(CASE WHEN json_type(meta, '$.n') = 'DOUBLE' THEN CAST(json_extract(meta, '$.n') AS DOUBLE) END) AS DOUBLE) AS total FROM j GROUP BY 1, 2")
def json_columns(spark, sf_dir):
    """Lists and numbers kept as JSON text: what cannot be read is an empty list, and only numbers are numbers."""
    k, m = F.col("event_id") % 4, F.col("event_id") % 3
    roles = F.when(k == 0, F.concat(F.lit('["a'), (F.col("event_id") % 5).cast("string"), F.lit('", "b"]'))).when(k == 1, "[broken").when(k == 2, F.lit(None)).otherwise("[]")
    meta = F.when(m == 0, '{"n": 2.5}').when(m == 1, '{"n": true}').otherwise('{"n": "7"}')
    j = table(spark, sf_dir, "events").select(k.alias("kind"), m.alias("meta_kind"), A.json_list(roles).alias("roles"), A.json_number(meta, "$.n").alias("x"))
    return j.groupBy("kind", "meta_kind").agg(F.count("*").alias("n"), F.sum(F.size("roles")).alias("n_roles"), F.sum("x").alias("total"))


@query("activity_cube", WITH_AUDIT + "SELECT event_category, status, count(*) AS n FROM audit GROUP BY CUBE (event_category, status)")
def activity_cube(spark, sf_dir):
    return audit_logs(spark, sf_dir).cube("event_category", "status").agg(F.count("*").alias("n"))


@query("user_sessions", WITH_AUDIT + """, e AS (SELECT user_id, created_at, CASE WHEN created_at >= lag(created_at) OVER w + INTERVAL 6 HOUR OR lag(created_at) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM audit WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY created_at)),
s AS (SELECT user_id, created_at, sum(opens) OVER (PARTITION BY user_id ORDER BY created_at RANGE UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(created_at) AS begins, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    """Runs of a user's events with less than six hours between them."""
    log = audit_logs(spark, sf_dir).where("user_id IS NOT NULL").withColumn("at", F.col("created_at").cast("timestamp"))
    s = log.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.min("created_at").alias("begins"), F.count("*").alias("n"))
    return s.select("user_id", "begins", "n")


@query("purchases_before_errors", WITH_AUDIT + "SELECT a.id AS purchase_id, b.id AS error_id FROM audit a JOIN audit b ON a.user_id = b.user_id AND b.created_at > a.created_at AND b.created_at <= a.created_at + INTERVAL 2 HOUR WHERE a.event_type = 'document.uploaded' AND b.event_type = 'chat.retrieval.failed'")
def purchases_before_errors(spark, sf_dir):
    """Interval join: failures of a user within two hours after an upload."""
    log = audit_logs(spark, sf_dir)
    pick = lambda kind, id, at: log.where(F.col("event_type") == kind).select("user_id", F.col("id").alias(id), F.col("created_at").alias(at))
    return A.within(pick("document.uploaded", "purchase_id", "t"), pick("chat.retrieval.failed", "error_id", "u"), "user_id", "t", "u", 7200).select("purchase_id", "error_id")


@query("approximate_users", WITH_AUDIT + "SELECT event_type, true AS near FROM audit GROUP BY 1")
def approximate_users(spark, sf_dir):
    """Whether approximate numbers of users are within ten percent of the exact ones."""
    log = audit_logs(spark, sf_dir)
    # Apart: beside an exact number, Spark keeps a sketch for each user, not for each type.
    about = log.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"))
    exact = log.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    both = about.join(exact.withColumnRenamed("event_type", "_type"), F.col("event_type").eqNullSafe(F.col("_type")))
    return both.select("event_type", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


@query("local_days", "SELECT CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def local_days(spark, sf_dir):
    """Events by the day of another time zone, five and a half hours ahead."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "+05:30")
    return table(spark, sf_dir, "events").groupBy(F.to_date(local).alias("day")).agg(F.count("*").alias("n"))
