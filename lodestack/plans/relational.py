"""Joins, windows, set operations and access control over documents, messages and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.bindings import DOCS_SQL, MESSAGES_SQL, documents, messages
from lodestack.operators import relational as R
from lodestack.plans.registry import query
from lodestack.session import table
from lodestack.shared import with_neighbours

WITH_DOCS = f"WITH {DOCS_SQL} "
CITED_SQL = f"""WITH {DOCS_SQL}, {MESSAGES_SQL}, cited AS (
  SELECT conversation_id, turn, pos, concat('src', (conversation_id + turn * pos) % 23) AS source FROM messages, (SELECT unnest([1, 2]) AS pos) WHERE role = 'assistant' AND pos <= 1 + turn % 2
) """


def citations(spark, sf_dir):
    """conversation_id, turn, pos, source: one or two synthetic citations of each answer."""
    m = messages(spark, sf_dir).where("role = 'assistant'")
    long = m.select("conversation_id", "turn", F.explode(F.sequence(F.lit(1), (F.col("turn") % 2 + 1).cast("int"))).alias("pos"))
    return long.withColumn("source", F.concat(F.lit("src"), ((F.col("conversation_id") + F.col("turn") * F.col("pos")) % 23).cast("string")))


@query("acl_filter", WITH_DOCS + """, r AS (SELECT *, (doc_id * 7) % 150 AS user_id FROM docs)
SELECT user_id, doc_id FROM r WHERE user_id % 10 = 0 OR owner_id = user_id OR visibility = 'public' OR (visibility = 'restricted' AND allowed_role = CASE user_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'hr' WHEN 2 THEN 'finance' ELSE 'it' END)""")
def acl_filter(spark, sf_dir):
    """One request for every document, and which of them are granted."""
    role = F.element_at(F.array(*[F.lit(r) for r in ("admin", "hr", "finance", "it")]), (F.col("user_id") % 4 + 1).cast("int"))
    asked = documents(spark, sf_dir).withColumn("user_id", (F.col("doc_id") * 7) % 150)
    seen = R.visible(F.col("user_id") % 10 == 0, F.col("user_id"), F.col("owner_id"), F.col("visibility"), F.array(role), F.array("allowed_role"))
    return asked.where(seen).select("user_id", "doc_id")


@query("acl_outcomes", WITH_DOCS + """, d AS (SELECT CASE WHEN owner_id = 7 THEN 'granted_owner' WHEN visibility = 'public' THEN 'granted_public' WHEN visibility = 'restricted' AND allowed_role IN ('hr', 'it') THEN 'granted_role'
  WHEN visibility = 'restricted' THEN 'denied_role' WHEN visibility = 'private' THEN 'denied_private' ELSE 'denied_unknown' END AS outcome FROM docs)
SELECT outcome, count(*) AS n FROM d GROUP BY 1""")
def acl_outcomes(spark, sf_dir):
    why = R.access_reason(F.lit(False), F.lit(7), F.col("owner_id"), F.col("visibility"), F.array(F.lit("hr"), F.lit("it")), F.array("allowed_role"))
    return documents(spark, sf_dir).groupBy(why.alias("outcome")).agg(F.count("*").alias("n"))


@query("exact_duplicates", "SELECT sha256(text) AS checksum, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("checksum")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


@query("duplicate_decision", WITH_DOCS + """SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 THEN 'exact_duplicate' WHEN row_number() OVER (PARTITION BY collection, file_size % 100 ORDER BY doc_id) > 1 THEN 'filename_conflict' ELSE 'new_document' END AS decision FROM docs""")
def duplicate_decision(spark, sf_dir):
    """What an upload in the order of ids would have decided: same content, same name (here: number in its collection), or new."""
    d = documents(spark, sf_dir).select("doc_id", "collection", (F.col("file_size") % 100).alias("name"), F.sha2("text", 256).alias("checksum"))
    earlier = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id")) > 1
    return d.select("doc_id", F.when(earlier("checksum"), "exact_duplicate").when(earlier("collection", "name"), "filename_conflict").otherwise("new_document").alias("decision"))


@query("version_latest", WITH_DOCS + """SELECT doc_id, collection, lang, row_number() OVER w AS version, row_number() OVER w = count(*) OVER (PARTITION BY collection, lang) AS is_latest,
  lag(doc_id) OVER w AS previous_id, lead(doc_id) OVER w AS next_id FROM docs WINDOW w AS (PARTITION BY collection, lang ORDER BY updated_s, doc_id)""")
def version_latest(spark, sf_dir):
    """Versions in the order of their time; a group of any size, as neighbours meet by number."""
    d = with_neighbours(documents(spark, sf_dir).select("doc_id", "collection", "lang", "updated_s"), ["collection", "lang"], ["updated_s", "doc_id"], "doc_id")
    return d.select("doc_id", "collection", "lang", F.col("place").cast("long").alias("version"), F.col("before").alias("previous_id"), F.col("after").alias("next_id"), F.col("after").isNull().alias("is_latest"))


@query("latest_by_max_by", WITH_DOCS + "SELECT collection, arg_max(doc_id, (updated_s, doc_id)) AS newest FROM docs GROUP BY 1")
def latest_by_max_by(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("collection").agg(F.max_by("doc_id", F.struct("updated_s", "doc_id")).alias("newest"))


@query("collection_usage_full_outer", CITED_SQL + """, a AS (SELECT collection, count(*) AS documents FROM docs GROUP BY 1), b AS (SELECT source AS collection, count(*) AS citations FROM cited GROUP BY 1),
c AS (SELECT collection, count(*) AS fresh FROM docs WHERE updated_s > 1706000000 GROUP BY 1)
SELECT collection, coalesce(documents, 0) AS documents, coalesce(citations, 0) AS citations, coalesce(fresh, 0) AS fresh FROM a FULL JOIN b USING (collection) FULL JOIN c USING (collection)""")
def collection_usage_full_outer(spark, sf_dir):
    d = documents(spark, sf_dir)
    a = d.groupBy("collection").agg(F.count("*").alias("documents"))
    b = citations(spark, sf_dir).groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("citations"))
    c = d.where("updated_s > 1706000000").groupBy("collection").agg(F.count("*").alias("fresh"))
    return a.join(b, "collection", "full_outer").join(c, "collection", "full_outer").na.fill(0)


@query("never_cited_anti", CITED_SQL + "SELECT doc_id, filename FROM docs WHERE doc_id NOT IN (SELECT conversation_id * 5 + turn * pos FROM cited)")
def never_cited_anti(spark, sf_dir):
    used = citations(spark, sf_dir).select((F.col("conversation_id") * 5 + F.col("turn") * F.col("pos")).alias("doc_id")).distinct()
    return documents(spark, sf_dir).join(used, "doc_id", "left_anti").select("doc_id", "filename")


@query("citations_with_default", CITED_SQL + """, k AS (SELECT DISTINCT collection FROM docs WHERE file_size > 16000)
SELECT coalesce(collection, 'Uncategorized') AS collection, count(*) AS n FROM cited LEFT JOIN k ON source = collection GROUP BY 1""")
def citations_with_default(spark, sf_dir):
    known = documents(spark, sf_dir).where("file_size > 16000").select("collection").distinct()
    c = citations(spark, sf_dir)
    return c.join(known, c["source"] == known["collection"], "left").groupBy(F.coalesce("collection", F.lit("Uncategorized")).alias("collection")).agg(F.count("*").alias("n"))


@query("citations_first_per_source", CITED_SQL + "SELECT conversation_id, source, min((turn, pos))[1] AS turn FROM cited GROUP BY 1, 2")
def citations_first_per_source(spark, sf_dir):
    return citations(spark, sf_dir).groupBy("conversation_id", "source").agg(F.min(F.struct("turn", "pos")).alias("first")).select("conversation_id", "source", "first.turn")


@query("diversify_by_source", WITH_DOCS + """, t AS (SELECT *, row_number() OVER (PARTITION BY lang, collection ORDER BY file_size DESC, doc_id) AS turn FROM docs),
p AS (SELECT lang, collection, doc_id, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN turn > 1 THEN 1 ELSE 0 END, file_size DESC, doc_id) AS position FROM t)
SELECT lang, collection, doc_id, CAST(position AS INTEGER) AS position FROM p WHERE position <= 25""")
def diversify_by_source(spark, sf_dir):
    d = documents(spark, sf_dir).select("lang", "collection", "doc_id", "file_size")
    return R.diversified(d, ["lang"], "collection", [F.desc("file_size"), F.col("doc_id")], 25).drop("file_size")


@query("contribution_share", CITED_SQL + """, a AS (SELECT c.source, length(m.content) / (1.0 + m.turn % 2) AS chars FROM cited c JOIN messages m USING (conversation_id, turn))
SELECT source, round(CAST(sum(chars) AS DOUBLE), 4) AS chars, round(CAST(sum(chars) AS DOUBLE) / sum(CAST(sum(chars) AS DOUBLE)) OVER () * 100, 4) AS share FROM a GROUP BY 1""")
def contribution_share(spark, sf_dir):
    m = messages(spark, sf_dir).select("conversation_id", "turn", F.length("content").alias("n"))
    c = citations(spark, sf_dir).join(m, ["conversation_id", "turn"]).withColumn("chars", F.col("n") / (F.col("turn") % 2 + 1))
    per = c.groupBy("source").agg(F.sum("chars").alias("chars"))
    return per.withColumn("total", F.sum("chars").over(Window.partitionBy())).select("source", F.round("chars", 4).alias("chars"), F.round(F.col("chars") / F.col("total") * 100, 4).alias("share"))


@query("ordered_distinct", f"WITH {MESSAGES_SQL} SELECT conversation_id, lower(role) AS role, min(turn) AS first_turn FROM messages GROUP BY 1, 2")
def ordered_distinct(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("conversation_id", F.lower("role").alias("role")).agg(F.min("turn").alias("first_turn"))


@query("set_operations", "SELECT k, 'either' AS kind FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT k, 'both' FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT k, 'customers_only' FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def set_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, n: df.withColumn("kind", F.lit(n))
    return tag(c.union(s).distinct(), "either").union(tag(c.intersect(s), "both")).union(tag(c.subtract(s), "customers_only"))


@query("shared_languages", WITH_DOCS + """, s AS (SELECT DISTINCT collection, lang FROM docs)
SELECT x.collection AS a, y.collection AS b, count(*) AS n FROM s x JOIN s y ON x.lang = y.lang AND x.collection < y.collection GROUP BY 1, 2 HAVING count(*) >= 2""")
def shared_languages(spark, sf_dir):
    sets = documents(spark, sf_dir).groupBy("collection").agg(F.collect_set("lang").alias("langs"))
    return R.shared_elements(sets, "collection", "langs", 2)


@query("adjacent_peers", WITH_DOCS + """, o AS (SELECT doc_id, collection, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos, lang FROM docs)
SELECT doc_id, (SELECT count(*) FROM o p WHERE p.lang = o.lang AND p.doc_id <> o.doc_id AND abs(p.pos - o.pos) <= 1 AND p.collection = o.collection) AS same_neighbours FROM o""")
def adjacent_peers(spark, sf_dir):
    same = lambda c: F.coalesce((F.col(c) == F.col("collection")).cast("long"), F.lit(0))
    d = with_neighbours(documents(spark, sf_dir).select("doc_id", "lang", "collection"), ["lang"], ["doc_id"], "collection")
    return d.select("doc_id", (same("before") + same("after")).alias("same_neighbours"))


@query("minmax_rerank_blend", WITH_DOCS + """, s AS (SELECT doc_id, lang, CAST(file_size AS DOUBLE) AS a, CAST(updated_s % 1000 AS DOUBLE) AS b FROM docs),
n AS (SELECT doc_id, lang, CASE WHEN max(a) OVER w = min(a) OVER w THEN 1.0::DOUBLE ELSE round((a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w), 4) END AS na, CASE WHEN max(b) OVER w = min(b) OVER w THEN 1.0::DOUBLE ELSE round((b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w), 4) END AS nb FROM s WINDOW w AS (PARTITION BY lang))
SELECT doc_id, lang, na, nb, round(0.55::DOUBLE * na + 0.45::DOUBLE * nb, 6) AS score FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(0.55::DOUBLE * na + 0.45::DOUBLE * nb, 6) DESC, doc_id) <= 40""")
def minmax_rerank_blend(spark, sf_dir):
    s = documents(spark, sf_dir).select("doc_id", "lang", F.col("file_size").cast("double").alias("a"), (F.col("updated_s") % 1000).cast("double").alias("b"))
    n = R.min_max(s, {"a": "na", "b": "nb"}, ["lang"]).withColumn("score", F.round(0.55 * F.col("na") + 0.45 * F.col("nb"), 6))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))
    return n.withColumn("r", rank).where("r <= 40").select("doc_id", "lang", "na", "nb", "score")


@query("upsert_by_key", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 4 = 0")
def upsert_by_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return R.upsert(c, c.where("c_custkey % 4 = 0").withColumn("c_name", F.upper("c_name")), "c_custkey")


MENTIONS_SQL = f"WITH {DOCS_SQL}, {MESSAGES_SQL}, said AS (SELECT conversation_id, turn, lower(concat(content, ' in SRC', conversation_id % 15, ' and file', conversation_id * 2 + turn, '.txt')) AS content FROM messages), files AS (SELECT collection, concat('File', doc_id, '.txt') AS filename FROM docs) "


def mentions(spark, sf_dir):
    """conversation_id, turn, content: messages that name a collection and a file."""
    c = F.col("conversation_id")
    return messages(spark, sf_dir).select("conversation_id", "turn", F.concat("content", F.lit(" in SRC"), (c % 15).cast("string"), F.lit(" and file"), (c * 2 + F.col("turn")).cast("string"), F.lit(".txt")).alias("content"))


def files(spark, sf_dir):
    return documents(spark, sf_dir).select("collection", F.concat(F.lit("File"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"))


@query("filename_containment", MENTIONS_SQL + "SELECT conversation_id, turn, min(collection) AS first_match FROM said JOIN (SELECT DISTINCT collection FROM docs) c ON contains(content, lower(collection)) GROUP BY 1, 2")
def filename_containment(spark, sf_dir):
    """First of all names of collections that a message contains."""
    found = R.first_contained(mentions(spark, sf_dir), documents(spark, sf_dir).select("collection"), ["conversation_id", "turn"], "content", "collection")
    return found.groupBy("conversation_id", "turn").agg(F.min("collection").alias("first_match"))


@query("never_searched_documents", MENTIONS_SQL + "SELECT filename FROM files f WHERE NOT EXISTS (SELECT 1 FROM said WHERE contains(content, lower(filename)))")
def never_searched_documents(spark, sf_dir):
    """Files that no message names."""
    f = files(spark, sf_dir).select("filename")
    return f.join(R.first_contained(mentions(spark, sf_dir), f, ["conversation_id", "turn"], "content", "filename").select("filename").distinct(), "filename", "left_anti")


@query("searches_by_collection", MENTIONS_SQL + ", m AS (SELECT conversation_id, turn, arg_min(collection, filename) AS collection FROM said JOIN files ON contains(content, lower(filename)) GROUP BY 1, 2) SELECT collection, count(*) AS n FROM m GROUP BY 1")
def searches_by_collection(spark, sf_dir):
    """Each message counts for the collection of the first file, by name, that it names."""
    f = files(spark, sf_dir)
    found = R.first_contained(mentions(spark, sf_dir), f, ["conversation_id", "turn"], "content", "filename").join(f, "filename")
    first = found.groupBy("conversation_id", "turn").agg(F.min_by("collection", "filename").alias("collection"))
    return first.groupBy("collection").agg(F.count("*").alias("n"))


@query("unused_documents_count", CITED_SQL + "SELECT count(*) AS n FROM docs WHERE doc_id NOT IN (SELECT conversation_id * 5 + turn * pos FROM cited)")
def unused_documents_count(spark, sf_dir):
    return never_cited_anti(spark, sf_dir).agg(F.count("*").alias("n"))


@query("star_schema_rollup", """SELECT r_name, n_name, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS BIGINT) AS revenue_e4, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND l_returnflag = 'R' GROUP BY ROLLUP (r_name, n_name)""")
def star_schema_rollup(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").where("l_returnflag = 'R'").join(t("orders").where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01'"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    revenue = F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("long")).alias("revenue_e4")
    return j.rollup("r_name", "n_name").agg(revenue, F.countDistinct("o_orderkey").alias("orders"))


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))
