"""Text, enrichment, index, graph and answer-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions import text as X
from lodestack.functions.bindings import DOCS_SQL, MESSAGES_SQL, documents, messages
from lodestack.operators import graph as G
from lodestack.operators import knowledge as K
from lodestack.operators import retrieval as R
from lodestack.plans.registry import query
from lodestack.session import table
from lodestack.shared import small, written

NAMED_SQL = X.named_words_sql("text")
STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
ENGLISH = ", ".join(f"'{w}'" for w in X.ENGLISH)
WITH_WORDS = f"WITH {DOCS_SQL}, w AS (SELECT doc_id, {X.tokens_sql('text')} AS w FROM documents) "


def words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("w"))


@query("token_counts", WITH_WORDS + f"SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: x NOT IN ({STOP}))) AS n_content FROM w")
def token_counts(spark, sf_dir):
    return words(spark, sf_dir).select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.size(X.without_stopwords(F.col("w"))).cast("long").alias("n_content"))


@query("stemmed_words", WITH_WORDS + f""", e AS (SELECT unnest(list_distinct(w)) AS t FROM w), d AS (SELECT DISTINCT t FROM e) SELECT t AS word, {X.stemmed_sql('t')} AS stem FROM d WHERE {X.stemmed_sql('t')} <> t""")
def stemmed_words(spark, sf_dir):
    """The words of the corpus that the stemmer shortens, and what is left of them."""
    e = words(spark, sf_dir).select(F.explode(F.array_distinct("w")).alias("word")).distinct()
    return e.select("word", X.stemmed(F.col("word")).alias("stem")).where("stem <> word")


@query("top_keywords", f"""WITH w AS (SELECT doc_id, {NAMED_SQL} AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM w), c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM e WHERE length(term) >= 3 AND term NOT IN ({ENGLISH}) GROUP BY 1, 2)
SELECT doc_id, term, n, CAST(row_number() OVER k AS INTEGER) AS rank FROM c WINDOW k AS (PARTITION BY doc_id ORDER BY n DESC, first) QUALIFY row_number() OVER k <= 15""")
def top_keywords(spark, sf_dir):
    """The 15 most frequent significant words of each document, ties by first place."""
    e = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.significant(X.named_words(F.col("text")))).alias("pos", "term"))
    c = e.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return K.top_terms(c, "doc_id", [F.desc("n"), F.col("first")], 15).select("doc_id", "term", "n", "rank")


@query("language_detect", f"""WITH w AS (SELECT lang, {NAMED_SQL} AS w FROM documents) SELECT CASE WHEN len(w) >= 20 AND len(list_filter(w, lambda x: x IN ({ENGLISH}))) / len(w) >= 0.12 THEN 'en' ELSE 'unknown' END AS detected, lang, count(*) AS n FROM w GROUP BY 1, 2""")
def language_detect(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(X.language(X.named_words(F.col("text"))).alias("detected"), "lang").agg(F.count("*").alias("n"))


@query("sentence_counts", r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: length(s) > 0)) AS n FROM documents")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query("whitespace_collapse", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM documents")
def whitespace_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.collapsed(F.col("text"))).alias("digest"))


@query("repeated_ngrams", WITH_WORDS + """, g AS (SELECT doc_id, unnest(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS gram FROM w WHERE len(w) >= 5)
SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 3""")
def repeated_ngrams(spark, sf_dir):
    """Runs of five words that a document has three times or more. A row's runs are sorted where it lies, and only those that stand there three times are counted; rows that share their
    doc_id with others hand on all of theirs."""
    own = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = small(written(own.select(F.col("doc_id").alias("_id"), F.lit(True).alias("shared")), "shared-ids"), R.BROADCAST_ROWS)
    w = words(spark, sf_dir).join(shared, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    runs = w.select("doc_id", "shared", F.array_sort(X.ngrams(F.col("w"), 5)).alias("s"))
    at = lambda i: F.get("s", i)
    near = lambda g, i: ((at(i - 2) == g) & (at(i - 1) == g)) | ((at(i - 1) == g) & (at(i + 1) == g)) | ((at(i + 1) == g) & (at(i + 2) == g))
    kept = F.filter("s", lambda g, i: F.col("shared").isNotNull() | F.coalesce(near(g, i), F.lit(False)))
    g = runs.select("doc_id", F.explode(kept).alias("gram"))
    return g.groupBy("doc_id", "gram").agg(F.count("*").alias("n")).where("n >= 3")


@query("names_and_excerpts", r"""WITH d AS (SELECT doc_id, concat('03 - ', source, '_report-', doc_id, '.v2.txt') AS name, text FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(name, '\.[^.]+$', ''), '^[0-9]+[ _.-]+', ''), '[_-]+', ' ', 'g')) AS title,
  substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) AS slug, CASE WHEN length(text) > 160 THEN concat(rtrim(substr(text, 1, 160)), '...') ELSE text END AS excerpt FROM d""")
def names_and_excerpts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("name", F.concat(F.lit("03 - "), "source", F.lit("_report-"), F.col("doc_id").cast("string"), F.lit(".v2.txt")))
    return d.select("doc_id", X.readable(F.col("name")).alias("title"), X.slug(F.col("name")).alias("slug"), X.excerpt(F.col("text")).alias("excerpt"))


@query("character_windows", """SELECT doc_id, i AS chunk, substr(text, i * 650 + 1, 800) AS content FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 150) / 650) AS BIGINT)))) AS i FROM documents)""")
def character_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    last = F.greatest(F.lit(1), F.ceil((F.length("text") - 150) / 650)) - 1
    long = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk"))
    return long.select("doc_id", "chunk", F.col("text").substr((F.col("chunk") * 650 + 1).cast("int"), F.lit(800)).alias("content"))


@query("line_statistics", r"SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')) AS n_blank, len(list_distinct(string_split(text, chr(10)))) AS n_distinct FROM documents")
def line_statistics(spark, sf_dir):
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long").alias("n_blank"), F.size(F.array_distinct(lines)).cast("long").alias("n_distinct"))


@query("boilerplate_lines", r"""WITH l AS (SELECT DISTINCT doc_id, regexp_replace(lower(trim(line)), '[0-9]+', '{page}', 'g') AS key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '')
SELECT key, count(*) AS n_documents FROM l GROUP BY 1 HAVING count(*) >= 4""")
def boilerplate_lines(spark, sf_dir):
    """Lines, with numbers made equal, that recur in several documents; repeats inside a document count once."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    key = F.regexp_replace(F.lower("line"), "[0-9]+", "{page}").alias("key")
    return d.where("line <> ''").select("doc_id", key).distinct().groupBy("key").agg(F.count("*").alias("n_documents")).where("n_documents >= 4")


@query("entity_patterns", r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS n_dates, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n_emails, len(regexp_extract_all(text, 'https?://[^\s]+')) AS n_links, len(list_distinct(regexp_extract_all(text, '[A-Z]{2,}-?[0-9]{2,}'))) AS n_codes FROM documents")
def entity_patterns(spark, sf_dir):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    codes = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z]{2,}-?[0-9]{2,}"), 0))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n("[0-9]{4}-[0-9]{2}-[0-9]{2}").alias("n_dates"), n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("n_emails"), n(r"https?://[^\s]+").alias("n_links"), codes.alias("n_codes"))


@query("document_type", WITH_WORDS + """SELECT CASE WHEN regexp_matches(text, '(?i)licen[cs]e|copyright') THEN 'legal' WHEN regexp_matches(text, '(?i)password|secret|token') THEN 'security' WHEN regexp_matches(text, '@|\\+[0-9]') THEN 'contact' WHEN regexp_matches(text, '\\|') THEN 'table' ELSE 'prose' END AS kind, count(*) AS n FROM docs GROUP BY 1""")
def document_type(spark, sf_dir):
    rules = (("legal", "(?i)licen[cs]e|copyright"), ("security", "(?i)password|secret|token"), ("contact", r"@|\+[0-9]"), ("table", r"\|"))
    return table(spark, sf_dir, "documents").groupBy(K.first_match(F.col("text"), rules, "prose").alias("kind")).agg(F.count("*").alias("n"))


@query("keyword_routing", f"""WITH {MESSAGES_SQL}, s AS (SELECT conversation_id, turn, (CASE WHEN contains(lower(content), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'is a') THEN 2 ELSE 0 END) AS a, (CASE WHEN contains(lower(content), 'der') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'und') THEN 1 ELSE 0 END) AS b FROM messages)
SELECT CASE WHEN a = 0 AND b = 0 THEN 'general' WHEN a >= b THEN 'english' ELSE 'german' END AS route, count(*) AS n FROM s GROUP BY 1""")
def keyword_routing(spark, sf_dir):
    route = K.keyword_route(F.col("content"), {"english": ("the", "is a"), "german": ("der", "und")}, "general")
    return messages(spark, sf_dir).groupBy(route.alias("route")).agg(F.count("*").alias("n"))


NAMES_SQL = """WITH d AS (SELECT doc_id, text, concat(source, CASE doc_id % 6 WHEN 0 THEN concat('_v', doc_id % 12) WHEN 1 THEN '_final' WHEN 2 THEN '_draft' WHEN 3 THEN concat('-rev', doc_id % 7, '_v2_final') WHEN 4 THEN concat('_', doc_id % 40) ELSE '' END) AS name FROM documents) """


def names(spark, sf_dir):
    """doc_id, text, name: file names with versions of several kinds."""
    k, num = F.col("doc_id") % 6, lambda n: (F.col("doc_id") % n).cast("string")
    tail = F.when(k == 0, F.concat(F.lit("_v"), num(12))).when(k == 1, "_final").when(k == 2, "_draft").when(k == 3, F.concat(F.lit("-rev"), num(7), F.lit("_v2_final"))).when(k == 4, F.concat(F.lit("_"), num(40))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("source", tail).alias("name"))


@query("version_numbers", NAMES_SQL + f"SELECT doc_id, {K.version_sql('name')} AS version, {K.version_group_sql('name')} AS group_key FROM d")
def version_numbers(spark, sf_dir):
    return names(spark, sf_dir).select("doc_id", K.version_of(F.col("name")).alias("version"), K.version_group(F.col("name")).alias("group_key"))


@query("taxonomy_ancestors", """WITH p AS (SELECT DISTINCT string_split(concat(lang, '/', source, '/', CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END), '/') AS p FROM documents), e AS (SELECT p, unnest([1, 2, 3]) AS depth FROM p)
SELECT DISTINCT array_to_string(p[1:depth], '/') AS path, CASE WHEN depth > 1 THEN array_to_string(p[1:depth - 1], '/') END AS parent, depth FROM e""")
def taxonomy_ancestors(spark, sf_dir):
    path = F.concat_ws("/", "lang", "source", F.when(F.col("n_chars") < 1000, "short").otherwise("long"))
    return K.ancestors(table(spark, sf_dir, "documents").select(path.alias("path")).distinct(), "path")


@query("document_health", WITH_WORDS + """SELECT CASE WHEN length(text) < 50 THEN 'empty' WHEN updated_s < 1704500000 THEN 'stale' WHEN len(w) > 0 AND len(list_distinct(w)) / len(w) < 0.2 THEN 'repetitive' WHEN visibility = 'private' THEN 'restricted' ELSE 'healthy' END AS health, count(*) AS n FROM docs JOIN w USING (doc_id) GROUP BY 1""")
def document_health(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("w", X.tokens(F.col("text")))
    few = (F.size("w") > 0) & (F.size(F.array_distinct("w")) / F.size("w") < 0.2)
    state = F.when(F.length("text") < 50, "empty").when(F.col("updated_s") < 1704500000, "stale").when(few, "repetitive").when(F.col("visibility") == "private", "restricted").otherwise("healthy")
    return d.groupBy(state.alias("health")).agg(F.count("*").alias("n"))


@query("inverted_index_lookup", WITH_WORDS + """, i AS (SELECT 'language' AS index_name, lower(lang) AS term, doc_id FROM docs UNION SELECT 'collection', lower(collection), doc_id FROM docs UNION SELECT 'word', t, doc_id FROM (SELECT doc_id, unnest(w) AS t FROM w))
SELECT index_name, term, count(*) AS n, min(doc_id) AS first_id FROM i GROUP BY 1, 2""")
def inverted_index_lookup(spark, sf_dir):
    """What a look-up of every term of every index gives: how many documents, and the first of them."""
    d = documents(spark, sf_dir)
    i = K.inverted(d, "doc_id", language=F.array("lang"), collection=F.array("collection"), word=X.tokens(F.col("text")))
    return i.groupBy("index_name", "term").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("index_statistics", WITH_WORDS + "SELECT count(*) AS entries, count(DISTINCT doc_id) AS documents, count(DISTINCT term) AS terms, round(avg(n), 6) AS mean_tf FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY 1, 2)")
def index_statistics(spark, sf_dir):
    p = words(spark, sf_dir).select("doc_id", F.explode("w").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return p.agg(F.count("*").alias("entries"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("term").alias("terms"), F.round(F.avg("n"), 6).alias("mean_tf"))


@query("jaccard_keyword_peers")
def jaccard_keyword_peers(spark, sf_dir):
    """For each document the smallest one of those with the same words of over two letters (its class), and how many other documents agree with it to 72 %.
    Equal sets are one, and classes are linked, not documents. Exact: of two sets of which 72 % are common, those words of each that are rarest, as many as could be
    missing and one more, have one in common."""
    sets = words(spark, sf_dir).select("doc_id", F.array_sort(F.array_distinct(F.filter("w", lambda t: F.length(t) > 2))).alias("terms"))
    return K.similar_classes(sets, "doc_id", 72)


EDGES_SQL = """WITH RECURSIVE edges AS (
  SELECT concat('nation:', n_nationkey) AS src, concat('region:', n_regionkey) AS dst, 'part_of' AS type, 0.9::DOUBLE AS confidence FROM nation
  UNION ALL SELECT concat('customer:', c_custkey), concat('nation:', c_nationkey), 'lives_in', 0.5::DOUBLE + (c_custkey % 5) / 10.0 FROM customer
  UNION ALL SELECT concat('supplier:', s_suppkey), concat('nation:', s_nationkey), 'located_in', 0.8::DOUBLE FROM supplier
), ways AS (SELECT src, dst, confidence FROM edges UNION ALL SELECT dst, src, confidence FROM edges) """


def edges(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    a = t("nation").select(name("nation", "n_nationkey").alias("src"), name("region", "n_regionkey").alias("dst"), F.lit("part_of").alias("type"), F.lit(0.9).alias("confidence"))
    b = t("customer").select(name("customer", "c_custkey").alias("src"), name("nation", "c_nationkey").alias("dst"), F.lit("lives_in").alias("type"), (0.5 + (F.col("c_custkey") % 5) / 10.0).alias("confidence"))
    c = t("supplier").select(name("supplier", "s_suppkey").alias("src"), name("nation", "s_nationkey").alias("dst"), F.lit("located_in").alias("type"), F.lit(0.8).alias("confidence"))
    return a.unionByName(b).unionByName(c)


@query("graph_bfs_levels", EDGES_SQL + """, walk(node, depth) AS (SELECT 'customer:1', 0 UNION SELECT dst, depth + 1 FROM walk JOIN ways ON src = node WHERE depth < 3 AND confidence >= 0.6)
SELECT node, min(depth) AS depth FROM walk GROUP BY 1""")
def graph_bfs_levels(spark, sf_dir):
    e = edges(spark, sf_dir)
    both = e.select("src", "dst", "confidence").union(e.select("dst", "src", "confidence"))
    return G.levels(both, spark.createDataFrame([("customer:1",)], "node string"), 3, 0.6)


@query("graph_components", EDGES_SQL + """, walk(node, reach) AS (SELECT src, src FROM ways UNION SELECT dst, dst FROM ways UNION SELECT w.node, b.dst FROM walk w JOIN ways b ON b.src = w.reach) SELECT node, min(reach) AS component FROM walk GROUP BY 1""")
def graph_components(spark, sf_dir):
    return G.components(edges(spark, sf_dir))


@query("graph_degrees", EDGES_SQL + "SELECT node, sum(o) AS n_out, sum(i) AS n_in, count(*) AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1")
def graph_degrees(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


@query("graph_statistics", EDGES_SQL + "SELECT type, count(*) AS n, count(DISTINCT dst) AS targets, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (confidence < 0.6) AS weak FROM edges GROUP BY 1")
def graph_statistics(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("targets"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("confidence") < 0.6).alias("weak"))


GROUNDED_SQL = f"""WITH {MESSAGES_SQL}, p AS (SELECT conversation_id, turn, role, content, lag(content) OVER (PARTITION BY conversation_id ORDER BY turn) AS evidence FROM messages),
t AS (SELECT conversation_id, turn, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]{{4,}}')) AS a, list_distinct(regexp_extract_all(lower(evidence), '[a-z0-9]{{4,}}')) AS e FROM p WHERE role = 'assistant' AND evidence IS NOT NULL),
u AS (SELECT conversation_id, turn, len(a) AS n, len(list_filter(a, lambda x: NOT list_contains(e, x))) AS missing FROM t) """


@query("answer_grounding", GROUNDED_SQL + "SELECT conversation_id, turn, n, missing, n > 0 AND missing / greatest(n, 1) > 0.45 AND missing >= 2 AS unsupported FROM u")
def answer_grounding(spark, sf_dir):
    """Words of an answer that the message before it lacks; unsupported above 45 % and from 2 words."""
    w = Window.partitionBy("conversation_id").orderBy("turn")
    m = messages(spark, sf_dir).withColumn("evidence", F.lag("content").over(w)).where("role = 'assistant' AND evidence IS NOT NULL")
    long = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{4,}"), 0))
    u = m.select("conversation_id", "turn", F.size(long("content")).cast("long").alias("n"), F.size(F.array_except(long("content"), long("evidence"))).cast("long").alias("missing"))
    return u.withColumn("unsupported", (F.col("n") > 0) & (F.col("missing") / F.greatest("n", F.lit(1)) > 0.45) & (F.col("missing") >= 2))


@query("failure_taxonomy", GROUNDED_SQL + """SELECT label, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n = 0 THEN 'empty_answer' END, CASE WHEN n > 0 AND missing = n THEN 'off_topic' END, CASE WHEN missing >= 2 AND missing / greatest(n, 1) > 0.45 THEN 'unsupported' END, CASE WHEN n > 60 THEN 'too_long' END], lambda x: x IS NOT NULL)) AS label FROM u) GROUP BY 1""")
def failure_taxonomy(spark, sf_dir):
    u = answer_grounding(spark, sf_dir)
    n, missing = F.col("n"), F.col("missing")
    tags = F.array_compact(F.array(F.when(n == 0, "empty_answer"), F.when((n > 0) & (missing == n), "off_topic"), F.when((missing >= 2) & (missing / F.greatest(n, F.lit(1)) > 0.45), "unsupported"), F.when(n > 60, "too_long")))
    return u.select(F.explode(tags).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("run_comparison", """WITH r AS (SELECT event_type AS metric, avg(value) FILTER (user_id % 2 = 0) AS a, avg(value) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY 1)
SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta, CASE WHEN a = 0 THEN NULL ELSE round((b - a) / a * 100, 4) END AS delta_pct FROM r""")
def run_comparison(spark, sf_dir):
    side = lambda k: F.avg(F.when(F.col("user_id") % 2 == k, F.col("value")))
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(side(0).alias("x"), side(1).alias("y"))
    d = F.col("y") - F.col("x")
    return r.select("metric", F.round("x", 6).alias("a"), F.round("y", 6).alias("b"), F.round(d, 6).alias("delta"), F.when(F.col("x") != 0, F.round(d / F.col("x") * 100, 4)).alias("delta_pct"))


@query("extractive_answers", f"""WITH q AS (SELECT item_id, list_distinct(list_filter({X.tokens_sql('text')}, lambda x: length(x) > 2)) AS w FROM benchmark),
s AS (SELECT doc_id, unnest(l) AS sentence, unnest(range(len(l))) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: length(x) > 0) AS l FROM documents)),
t AS (SELECT doc_id, pos, unnest(list_distinct({X.tokens_sql('sentence')})) AS term FROM s), h AS (SELECT item_id, doc_id, pos, count(*) AS hits FROM (SELECT item_id, unnest(w) AS term FROM q) JOIN t USING (term) GROUP BY 1, 2, 3)
SELECT item_id, doc_id, pos, hits FROM h QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id, pos) <= 3""")
def extractive_answers(spark, sf_dir):
    """For each item the three sentences that share most words of over two letters with it."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.filter(X.tokens(F.col("text")), lambda w: F.length(w) > 2))).alias("term"))
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
    h = K.best_sentences(s.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_distinct(X.tokens(F.col("sentence"))).alias("terms")), q, 3)
    return h.select(F.col("item").alias("item_id"), "doc_id", "pos", "hits")
