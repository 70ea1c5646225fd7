"""Activity analytics: counts, users, errors, health, latency, freshness and usage."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.bindings import AUDIT_SQL, DOCS_SQL, EPOCH, MESSAGES_SQL, audit_logs, documents, messages, users
from lodestack.operators import activity as A
from lodestack.plans.registry import query
from lodestack.session import table

WITH_AUDIT = f"WITH {AUDIT_SQL} "
SERVICE_SQL = "CASE WHEN event_type LIKE 'auth.%' THEN 'authentication' WHEN event_type LIKE 'security.%' THEN 'security' WHEN event_type LIKE 'chat.%' THEN 'chat' WHEN event_type LIKE 'document.%' THEN 'documents' ELSE lower(event_category) END"


@query(
    "daily_event_counts",
    "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2",
)
def daily_event_counts(spark, sf_dir):
    return A.daily(table(spark, sf_dir, "events"), "ts", F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"), keys=("event_type",))


@query("daily_counts_gap_filled", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day)
SELECT s.day, coalesce(n, 0) AS n FROM s LEFT JOIN d ON s.day = d.day""")
def daily_counts_gap_filled(spark, sf_dir):
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    return A.with_gaps_filled(A.daily(errors, "ts", F.count("*").alias("n")), "day", "n")


@query("dau_wau_mau", """
WITH a AS (SELECT max(ts) AS anchor FROM events)
SELECT count(DISTINCT CASE WHEN ts >= anchor - INTERVAL 1 DAY THEN user_id END) AS dau, count(DISTINCT CASE WHEN ts >= anchor - INTERVAL 7 DAY THEN user_id END) AS wau,
  count(DISTINCT CASE WHEN ts >= anchor - INTERVAL 30 DAY THEN user_id END) AS mau FROM events, a""")
def dau_wau_mau(spark, sf_dir):
    return A.trailing_distinct(table(spark, sf_dir, "events"), "user_id", "ts")


@query("events_in_window", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-11 23:59:59.999999' GROUP BY 1")
def events_in_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(A.in_window("ts", "2024-01-05 00:00:00", "2024-01-11 23:59:59.999999")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("events_by_week_and_month", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM events GROUP BY 1, 2")
def events_by_week_and_month(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), F.to_date(F.date_trunc("month", "ts")).alias("month")).agg(F.count("*").alias("n"))


TOP_SQL = WITH_AUDIT + """, q AS (SELECT user_id, count(*) AS question_count, max(created_at) AS last_active_at FROM audit WHERE event_type = 'chat.question.asked' AND user_id IS NOT NULL GROUP BY 1)
SELECT c_custkey AS user_id, c_name AS name, question_count, last_active_at FROM q JOIN customer ON c_custkey = user_id """


@query("top_active_users", TOP_SQL + "ORDER BY question_count DESC, user_id LIMIT 10")
def top_active_users(spark, sf_dir):
    asked = audit_logs(spark, sf_dir).where("event_type = 'chat.question.asked' AND user_id IS NOT NULL")
    counts = asked.groupBy("user_id").agg(F.count("*").alias("question_count"), F.max("created_at").alias("last_active_at"))
    return counts.join(users(spark, sf_dir), "user_id").select("user_id", "name", "question_count", "last_active_at").orderBy(F.desc("question_count"), "user_id").limit(10)


@query("least_active_users", WITH_AUDIT + """, q AS (SELECT user_id, count(*) AS n FROM audit WHERE event_type = 'chat.question.asked' GROUP BY 1)
SELECT c_custkey AS user_id, coalesce(n, 0) AS question_count FROM customer LEFT JOIN q ON user_id = c_custkey WHERE c_acctbal > 0 ORDER BY question_count, user_id LIMIT 20""")
def least_active_users(spark, sf_dir):
    counts = audit_logs(spark, sf_dir).where("event_type = 'chat.question.asked'").groupBy("user_id").agg(F.count("*").alias("n"))
    own = users(spark, sf_dir).where("is_active").join(counts, "user_id", "left")
    return own.select("user_id", F.coalesce("n", F.lit(0)).alias("question_count")).orderBy("question_count", "user_id").limit(20)


@query("inactive_users", "SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND ts >= TIMESTAMP '2024-01-10')")
def inactive_users(spark, sf_dir):
    seen = table(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-10' AND user_id IS NOT NULL").select("user_id")
    return users(spark, sf_dir).where("is_active").join(seen, "user_id", "left_anti").select("user_id", "name")


@query("errors_by_service", WITH_AUDIT + f"SELECT {SERVICE_SQL} AS service, event_category, count(*) AS n FROM audit WHERE status = 'failed' GROUP BY 1, 2")
def errors_by_service(spark, sf_dir):
    failed = audit_logs(spark, sf_dir).where("status = 'failed'")
    return failed.groupBy(A.service(F.col("event_type"), F.col("event_category")).alias("service"), "event_category").agg(F.count("*").alias("n"))


@query("recurring_errors", WITH_AUDIT + "SELECT concat('reason-', k % 7) AS reason, event_category, count(*) AS n FROM audit WHERE status = 'failed' GROUP BY 1, 2 HAVING count(*) > 1")
def recurring_errors(spark, sf_dir):
    failed = audit_logs(spark, sf_dir).where("status = 'failed'")
    return failed.groupBy(F.concat(F.lit("reason-"), (F.col("k") % 7).cast("string")).alias("reason"), "event_category").agg(F.count("*").alias("n")).where("n > 1")


@query("failure_reasons", WITH_AUDIT + "SELECT coalesce(nullif(trim(CASE WHEN k % 5 = 0 THEN ' ' ELSE concat('reason-', k % 7) END), ''), 'unspecified') AS reason, count(*) AS n FROM audit WHERE status = 'failed' GROUP BY 1")
def failure_reasons(spark, sf_dir):
    raw = F.when(F.col("k") % 5 == 0, " ").otherwise(F.concat(F.lit("reason-"), (F.col("k") % 7).cast("string")))
    reason = F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit("unspecified"))
    return audit_logs(spark, sf_dir).where("status = 'failed'").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("endpoint_failures", WITH_AUDIT + f"SELECT concat_ws(':', lower(event_category), CAST(k % 3 AS VARCHAR)) AS endpoint, {SERVICE_SQL} AS service, count(*) AS n FROM audit WHERE status = 'failed' GROUP BY 1, 2")
def endpoint_failures(spark, sf_dir):
    a = audit_logs(spark, sf_dir).where("status = 'failed'")
    endpoint = F.concat_ws(":", F.lower("event_category"), (F.col("k") % 3).cast("string"))
    return a.groupBy(endpoint.alias("endpoint"), A.service(F.col("event_type"), F.col("event_category")).alias("service")).agg(F.count("*").alias("n"))


@query("kpi_overview", WITH_AUDIT + """
SELECT count(*) AS events, count(*) FILTER (event_type = 'chat.question.asked') AS asked, count(*) FILTER (event_type = 'chat.answer.generated') AS answered, count(*) FILTER (status = 'failed') AS failed,
  round(count(*) FILTER (status = 'failed') / count(*) * 100, 2) AS failure_pct, count(DISTINCT user_id) AS users,
  round(count(*) FILTER (event_type = 'chat.question.asked') / count(DISTINCT user_id), 4) AS questions_per_user FROM audit""")
def kpi_overview(spark, sf_dir):
    a = audit_logs(spark, sf_dir)
    asked = F.count_if(F.col("event_type") == "chat.question.asked")
    failed = F.count_if(F.col("status") == "failed")
    people = F.countDistinct("user_id")
    return a.agg(
        F.count("*").alias("events"),
        asked.alias("asked"),
        F.count_if(F.col("event_type") == "chat.answer.generated").alias("answered"),
        failed.alias("failed"),
        A.ratio(failed, F.count("*")).alias("failure_pct"),
        people.alias("users"),
        F.round(asked / people, 4).alias("questions_per_user"),
    )


@query("user_engagement", WITH_AUDIT + """, u AS (SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active FROM customer),
q AS (SELECT count(*) AS n, count(DISTINCT user_id) AS askers FROM audit WHERE event_type = 'chat.question.asked')
SELECT round(active / total * 100, 2) AS active_pct, round(n / askers, 4) AS questions_per_asker, round((active / total * 100 + askers / total * 100) / 2, 2) AS engagement FROM u, q""")
def user_engagement(spark, sf_dir):
    u = users(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"))
    q = audit_logs(spark, sf_dir).where("event_type = 'chat.question.asked'").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("askers"))
    both = u.join(F.broadcast(q))  # one row each
    share = lambda c: F.col(c) / F.col("total") * 100
    return both.select(F.round(share("active"), 2).alias("active_pct"), F.round(F.col("n") / F.col("askers"), 4).alias("questions_per_asker"), F.round((share("active") + share("askers")) / 2, 2).alias("engagement"))


@query("health_status", WITH_AUDIT + """, h AS (SELECT event_category, count(*) AS attempts, count(*) FILTER (status = 'failed') AS failed FROM audit GROUP BY 1)
SELECT event_category, attempts, failed, CASE WHEN attempts = 0 THEN 'healthy' WHEN failed / attempts >= 0.5 THEN 'unavailable' WHEN failed / attempts >= 0.2 THEN 'degraded' ELSE 'healthy' END AS status FROM h""")
def health_status(spark, sf_dir):
    h = audit_logs(spark, sf_dir).groupBy("event_category").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "failed").alias("failed"))
    return h.withColumn("status", A.health(F.col("failed"), F.col("attempts")))


@query("worst_health", WITH_AUDIT + """, h AS (SELECT event_category, count(*) FILTER (status = 'failed') / count(*) AS r FROM audit GROUP BY 1),
s AS (SELECT CASE WHEN r >= 0.5 THEN 2 WHEN r >= 0.2 THEN 1 ELSE 0 END AS severity FROM h)
SELECT CASE max(severity) WHEN 2 THEN 'unavailable' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS overall FROM s""")
def worst_health(spark, sf_dir):
    order = F.element_at(F.create_map(F.lit("healthy"), F.lit(0), F.lit("degraded"), F.lit(1), F.lit("unavailable"), F.lit(2)), F.col("status"))
    return health_status(spark, sf_dir).agg(F.max_by("status", order).alias("overall"))


LATENCY_SQL = f"""WITH {MESSAGES_SQL}, p AS (
  SELECT *, lag(role) OVER w AS before, lag(created_s) OVER w AS asked FROM messages WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conversation_id ORDER BY created_s, turn)
), latency AS (SELECT conversation_id, turn, created_s, created_s - asked AS seconds FROM p WHERE role = 'assistant' AND before = 'user' AND created_s >= asked) """


@query("chat_latency_samples", LATENCY_SQL + "SELECT conversation_id, turn, seconds FROM latency")
def chat_latency_samples(spark, sf_dir):
    return A.response_times(messages(spark, sf_dir))


@query("latency_percentiles", LATENCY_SQL + "SELECT count(*) AS n, min(seconds) AS least, max(seconds) AS most, round(avg(seconds), 6) AS mean, round(quantile_cont(seconds, 0.5), 6) AS p50, round(quantile_cont(seconds, 0.95), 6) AS p95 FROM latency")
def latency_percentiles(spark, sf_dir):
    s = F.col("seconds")
    p = lambda q: F.round(F.percentile(s, F.lit(q)), 6)
    return A.response_times(messages(spark, sf_dir)).agg(F.count("*").alias("n"), F.min(s).alias("least"), F.max(s).alias("most"), F.round(F.avg(s), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("daily_avg_metadata", WITH_AUDIT + "SELECT CAST(created_at AS DATE) AS day, CAST(round_even(avg(k), 0) AS INTEGER) AS mean_k FROM audit WHERE event_type = 'chat.answer.generated' GROUP BY 1")
def daily_avg_metadata(spark, sf_dir):
    a = audit_logs(spark, sf_dir).where("event_type = 'chat.answer.generated'")
    return A.daily(a, "created_at", F.bround(F.avg("k")).cast("int").alias("mean_k"))


@query("pooled_average", WITH_AUDIT + f", {MESSAGES_SQL} SELECT round(avg(v), 6) AS mean FROM (SELECT CAST(k AS DOUBLE) AS v FROM audit UNION ALL SELECT CAST(length(content) AS DOUBLE) FROM messages WHERE role = 'assistant')")
def pooled_average(spark, sf_dir):
    a = audit_logs(spark, sf_dir).select(F.col("k").cast("double").alias("v"))
    m = messages(spark, sf_dir).where("role = 'assistant'").select(F.length("content").cast("double").alias("v"))
    return a.unionByName(m).agg(F.round(F.avg("v"), 6).alias("mean"))


@query("top_questions", f"WITH {MESSAGES_SQL} SELECT regexp_replace(trim(content), '\\s+', ' ', 'g') AS question, count(*) AS n FROM messages WHERE role = 'user' GROUP BY 1 ORDER BY n DESC, question LIMIT 25")
def top_questions(spark, sf_dir):
    q = F.regexp_replace(F.trim("content"), r"\s+", " ")
    return messages(spark, sf_dir).where("role = 'user'").groupBy(q.alias("question")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "question").limit(25)


@query("recent_messages_per_conversation", f"WITH {MESSAGES_SQL} SELECT conversation_id, turn, role, created_s FROM messages QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_s DESC, turn DESC) <= 3")
def recent_messages_per_conversation(spark, sf_dir):
    m = messages(spark, sf_dir).select("conversation_id", "turn", "role", "created_s")
    return A.last_per_group(m, ["conversation_id"], [F.desc("created_s"), F.desc("turn")], 3)


@query("context_budget", f"""WITH {MESSAGES_SQL}, r AS (SELECT conversation_id, turn, sum(length(content)) OVER (PARTITION BY conversation_id ORDER BY created_s DESC, turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM messages)
SELECT conversation_id, turn, CAST(used AS BIGINT) AS used FROM r WHERE used <= 800""")
def context_budget(spark, sf_dir):
    w = Window.partitionBy("conversation_id").orderBy(F.desc("created_s"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    m = messages(spark, sf_dir)
    return m.select("conversation_id", "turn", F.sum(F.length("content")).over(w).alias("used")).where("used <= 800")


@query("previous_turn", f"""WITH {MESSAGES_SQL} SELECT conversation_id, turn, last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_answer FROM messages""")
def previous_turn(spark, sf_dir):
    w = Window.partitionBy("conversation_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return messages(spark, sf_dir).select("conversation_id", "turn", F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(w).alias("last_answer"))


@query("messages_per_conversation_left", f"""WITH {MESSAGES_SQL}, a AS (SELECT conversation_id, count(*) AS answers FROM messages WHERE role = 'assistant' GROUP BY 1), s AS (SELECT conversation_id, count(*) AS notes FROM messages WHERE role = 'system' GROUP BY 1)
SELECT a.conversation_id, answers, coalesce(notes, 0) AS notes FROM a LEFT JOIN s USING (conversation_id)""")
def messages_per_conversation_left(spark, sf_dir):
    m = messages(spark, sf_dir)
    a = m.where("role = 'assistant'").groupBy("conversation_id").agg(F.count("*").alias("answers"))
    s = m.where("role = 'system'").groupBy("conversation_id").agg(F.count("*").alias("notes"))
    return a.join(s, "conversation_id", "left").select("conversation_id", "answers", F.coalesce("notes", F.lit(0)).alias("notes"))


@query("event_type_counters", WITH_AUDIT + "SELECT CAST(created_at AS DATE) AS day, count(*) FILTER (event_type = 'chat.question.asked') AS asked, count(*) FILTER (event_type = 'chat.answer.generated') AS answered, count(*) FILTER (event_type = 'document.uploaded') AS uploaded, count(*) FILTER (event_type = 'auth.login.success') AS logins FROM audit GROUP BY 1")
def event_type_counters(spark, sf_dir):
    names = {"chat.question.asked": "asked", "chat.answer.generated": "answered", "document.uploaded": "uploaded", "auth.login.success": "logins"}
    return A.daily(audit_logs(spark, sf_dir), "created_at", *[F.count_if(F.col("event_type") == t).alias(n) for t, n in names.items()])


@query("trend_series", WITH_AUDIT + "SELECT CAST(created_at AS DATE) AS day, event_type AS series, count(*) AS n FROM audit GROUP BY 1, 2 UNION ALL SELECT CAST(created_at AS DATE), 'failed', count(*) FROM audit WHERE status = 'failed' GROUP BY 1")
def trend_series(spark, sf_dir):
    a = audit_logs(spark, sf_dir)
    tags = F.explode(F.array_compact(F.array(F.col("event_type"), F.when(F.col("status") == "failed", "failed"))))
    return a.select("created_at", tags.alias("series")).groupBy(F.to_date("created_at").alias("day"), "series").agg(F.count("*").alias("n"))


@query("document_inventory", f"WITH {DOCS_SQL} SELECT count(*) AS documents, count(DISTINCT collection) AS collections, coalesce(sum(file_size), 0) AS bytes, count(*) FILTER (visibility = 'public') AS public_documents FROM docs")
def document_inventory(spark, sf_dir):
    return documents(spark, sf_dir).agg(F.count("*").alias("documents"), F.countDistinct("collection").alias("collections"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.count_if(F.col("visibility") == "public").alias("public_documents"))


@query("docs_per_collection", f"WITH {DOCS_SQL} SELECT coalesce(nullif(trim(collection), ''), 'Uncategorized') AS collection, count(*) AS n, sum(file_size) AS bytes FROM docs GROUP BY 1")
def docs_per_collection(spark, sf_dir):
    name = F.coalesce(F.nullif(F.trim("collection"), F.lit("")), F.lit("Uncategorized"))
    return documents(spark, sf_dir).groupBy(name.alias("collection")).agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


@query("freshness", f"WITH {DOCS_SQL} SELECT doc_id, filename, greatest(({EPOCH + 2592000} - updated_s) // 86400, 0) AS days_inactive FROM docs ORDER BY updated_s, doc_id LIMIT 50")
def freshness(spark, sf_dir):
    days = F.greatest(F.floor((F.lit(EPOCH + 2592000) - F.col("updated_s")) / 86400), F.lit(0)).cast("long")
    return documents(spark, sf_dir).orderBy("updated_s", "doc_id").limit(50).select("doc_id", "filename", days.alias("days_inactive"))


@query("breakdown_grouping_sets", "SELECT lang, source, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS size, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END))")
def breakdown_grouping_sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("size"))
    return d.groupingSets([["lang"], ["source"], ["size"]], "lang", "source", "size").agg(F.count("*").alias("n"))


@query("report_unpivot", WITH_AUDIT + """, k AS (SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (status = 'failed') AS failed FROM audit)
SELECT metric, CAST(value AS BIGINT) AS value FROM (UNPIVOT k ON events, users, failed INTO NAME metric VALUE value)""")
def report_unpivot(spark, sf_dir):
    k = audit_logs(spark, sf_dir).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("status") == "failed").alias("failed"))
    return k.unpivot([], ["events", "users", "failed"], "metric", "value")


@query("audit_search_page", WITH_AUDIT + "SELECT id, user_id, event_type, created_at FROM audit WHERE event_category = 'CHAT' AND status = 'success' AND event_type ILIKE '%ANSWER%' AND k >= 3 ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def audit_search_page(spark, sf_dir):
    a = audit_logs(spark, sf_dir).where((F.col("event_category") == "CHAT") & (F.col("status") == "success") & F.col("event_type").ilike("%ANSWER%") & (F.col("k") >= 3))
    return A.page(a.select("id", "user_id", "event_type", "created_at"), [F.desc("created_at"), F.col("id")], 40, 20)


@query("no_result_searches", WITH_AUDIT + "SELECT count(*) FILTER (event_type = 'chat.retrieval.failed') AS failures, count(*) FILTER (event_type = 'chat.answer.generated' AND k % 5 = 0) AS uncited FROM audit")
def no_result_searches(spark, sf_dir):
    t = F.col("event_type")
    return audit_logs(spark, sf_dir).agg(F.count_if(t == "chat.retrieval.failed").alias("failures"), F.count_if((t == "chat.answer.generated") & (F.col("k") % 5 == 0)).alias("uncited"))


@query("average_citations", WITH_AUDIT + "SELECT round(avg(k % 5), 6) AS per_response, round(avg(CASE WHEN k % 5 > 0 THEN k % 5 END), 6) AS per_cited FROM audit WHERE event_type = 'chat.answer.generated'")
def average_citations(spark, sf_dir):
    n = F.col("k") % 5
    return audit_logs(spark, sf_dir).where("event_type = 'chat.answer.generated'").agg(F.round(F.avg(n), 6).alias("per_response"), F.round(F.avg(F.when(n > 0, n)), 6).alias("per_cited"))
