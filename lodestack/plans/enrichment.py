"""Knowledge about documents: departments, types, collections, concepts, indexes, relations, candidates and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions.fixed import BUCKETS, CONCEPTS, DEPARTMENTS, EDGE_WEIGHTS, EXPANSIONS, FILE_CATEGORIES, INDEX_POINTS, NAME_STOPWORDS, TYPE_COLLECTIONS, TYPE_NAMES, TYPES
from lodestack.operators import graph as G
from lodestack.operators import knowledge as K
from lodestack.operators import relational as R
from lodestack.plans.registry import query
from lodestack.session import table
from lodestack.shared import written

#: Phrases of all rules, of which each document gets two at its end.
PHRASES = tuple(p for rules in (DEPARTMENTS, [(n, p) for n, _, p in TYPES], CONCEPTS) for _, ps in rules for p in ps)
STEMS = (*FILE_CATEGORIES, "research_notes", "draft_contract", "cv", "service_desk", "meeting_agenda", "annual_invoice", "archive_2020")
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
ENTRIES_SQL = f"""WITH entries AS (SELECT doc_id, lower(concat(text, ' ', {_LIST(PHRASES)}[1 + doc_id % {len(PHRASES)}], ' and ', {_LIST(PHRASES)}[1 + (doc_id * 7 + 3) % {len(PHRASES)}], '.')) AS text, {_LIST(STEMS)}[1 + doc_id % {len(STEMS)}] AS stem, source FROM documents),
category AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{c}')" for n, c in FILE_CATEGORIES.items())}) AS c(stem, category)) """


def entries(spark, sf_dir):
    """doc_id, text (lower case, with phrases of the rules), stem (a file's name), source."""
    pick = lambda xs, k: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    d = F.col("doc_id")
    text = F.lower(F.concat("text", F.lit(" "), pick(PHRASES, d), F.lit(" and "), pick(PHRASES, d * 7 + 3), F.lit(".")))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), pick(STEMS, d).alias("stem"), "source")


_RULES = lambda rules: ", ".join(f"({i}, '{n}', '" + p.replace("'", "''") + "')" for i, (n, ps) in enumerate(rules) for p in ps)
DEPARTMENTS_SQL = ENTRIES_SQL + f""", rule AS (SELECT * FROM (VALUES {_RULES(DEPARTMENTS)}) AS r(ord, name, phrase)), named AS (SELECT doc_id, CASE category WHEN 'hr' THEN 'HR' WHEN 'employee' THEN 'HR' WHEN 'finance' THEN 'Finance' WHEN 'security' THEN 'Security' END AS given FROM entries LEFT JOIN category USING (stem)),
hit AS (SELECT doc_id, ord, name, count(*) AS n FROM entries, rule WHERE contains(text, phrase) OR contains(stem, replace(phrase, ' ', '_')) GROUP BY 1, 2, 3),
weighed AS (SELECT doc_id, ord, name, CASE WHEN n >= 2 THEN least(0.93::DOUBLE, 0.7::DOUBLE + 0.08::DOUBLE * n) WHEN given IS NOT DISTINCT FROM name THEN 0.0::DOUBLE ELSE 0.55::DOUBLE END AS w FROM hit JOIN named USING (doc_id)
  UNION ALL SELECT doc_id, -1, given, 0.9::DOUBLE FROM named WHERE given IS NOT NULL),
best AS (SELECT doc_id, name, round(max(w), 3) AS score, min(ord) AS ord FROM weighed GROUP BY 1, 2 HAVING max(w) > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS place FROM best),
departments AS (SELECT doc_id, place, name, score FROM placed WHERE place = 1 OR (place = 2 AND score >= 0.7) UNION ALL SELECT doc_id, 1, 'Unknown', 0.35 FROM entries WHERE doc_id NOT IN (SELECT doc_id FROM best)) """


def described(spark, sf_dir):
    """entries with departments, type, collections, concepts and taxonomy path."""
    e = entries(spark, sf_dir)
    counts = K.phrase_counts(F.col("text"), F.col("stem"))
    e = e.withColumns(counts).withColumns({"departments": K.departments(F.col("text"), F.col("stem"), R.file_category(F.col("stem")), counts=True), "kind": K.document_type(F.col("text"), F.col("stem"), counts=True), "concepts": K.concepts(F.col("text"))}).drop(*counts)
    e = e.withColumn("collections", K.collections(F.transform("departments", lambda d: d["name"]), F.col("kind.name"), F.col("stem")))
    return e.withColumn("path", K.taxonomy(F.get("collections", 0), F.col("kind.name"), F.get("concepts", 0)))


@query("departments", DEPARTMENTS_SQL + "SELECT doc_id, CAST(place AS INTEGER) AS place, name, CAST(score AS DOUBLE) AS score FROM departments")
def departments(spark, sf_dir):
    """One or two departments of each document, with their scores."""
    e = entries(spark, sf_dir)
    own = e.select("doc_id", F.posexplode(K.departments(F.col("text"), F.col("stem"), R.file_category(F.col("stem")))).alias("at", "d"))
    return own.select("doc_id", (F.col("at") + 1).alias("place"), "d.name", "d.score")


_STRONG = " OR ".join("stem {0}".format(x) for x in ("= hint", "LIKE concat('%\\_', hint) ESCAPE '\\'", "LIKE concat(hint, '\\_%') ESCAPE '\\'"))
TYPES_SQL = ENTRIES_SQL + f""", hint AS (SELECT * FROM (VALUES {_RULES(TYPE_NAMES)}) AS h(ord, name, hint)), rule AS (SELECT r.*, s.base FROM (VALUES {_RULES([(n, p) for n, _, p in TYPES])}) AS r(ord, name, phrase) JOIN (VALUES {', '.join(f"('{n}', {b}::DOUBLE)" for n, b, _ in TYPES)}) AS s(name, base) USING (name)),
locked AS (SELECT doc_id, arg_min(name, ord) AS name, arg_min(score, ord) AS score FROM (SELECT doc_id, ord, name, max(CASE WHEN {_STRONG} THEN 0.94::DOUBLE ELSE 0.9::DOUBLE END) AS score FROM entries, hint WHERE contains(stem, hint) GROUP BY 1, 2, 3) GROUP BY 1),
said AS (SELECT doc_id, ord, name, round(least(0.98::DOUBLE, base + 0.03::DOUBLE * (count(*) - 1)), 3) AS score FROM entries, rule WHERE contains(concat(stem, chr(10), text), phrase) GROUP BY doc_id, ord, name, base),
spoken AS (SELECT doc_id, arg_min(name, (-score, ord)) AS name, max(score) AS score FROM said GROUP BY 1),
types AS (SELECT doc_id, coalesce(l.name, s.name, CASE WHEN regexp_matches(concat(stem, chr(10), text), 'incident|response|playbook') THEN 'Manual' ELSE 'Unknown' END) AS kind, coalesce(l.score, s.score, CASE WHEN regexp_matches(concat(stem, chr(10), text), 'incident|response|playbook') THEN 0.7::DOUBLE ELSE 0.35::DOUBLE END) AS score FROM entries LEFT JOIN locked l USING (doc_id) LEFT JOIN spoken s USING (doc_id)) """


@query("document_types", TYPES_SQL + "SELECT doc_id, kind, score FROM types")
def document_types(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("k", K.document_type(F.col("text"), F.col("stem")))
    return e.select("doc_id", F.col("k.name").alias("kind"), F.col("k.score").alias("score"))


_ALIASES = ", ".join(f"({i}, '{n}', '{a}')" for i, (n, aliases) in enumerate(CONCEPTS) for a in aliases)
CONCEPTS_SQL = f""", alias AS (SELECT * FROM (VALUES {_ALIASES}) AS a(ord, concept, alias)), concepts AS (SELECT DISTINCT doc_id, ord, concept FROM entries, alias WHERE regexp_matches(concat(' ', text, ' '), concat('[^a-z0-9]', alias, '[^a-z0-9]'))) """


@query("concept_mentions", ENTRIES_SQL + CONCEPTS_SQL + "SELECT concept, count(*) AS n FROM concepts GROUP BY 1")
def concept_mentions(spark, sf_dir):
    """Documents in which each concept is named, by any of its names."""
    return entries(spark, sf_dir).select(F.explode(K.concepts(F.col("text"))).alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))


COLLECTIONS_SQL = DEPARTMENTS_SQL + TYPES_SQL[len(ENTRIES_SQL) :].replace("rule AS", "type_rule AS").replace("FROM entries, rule", "FROM entries, type_rule") + f""", offered AS (
  SELECT doc_id, lower(name) AS collection, place FROM departments WHERE name <> 'Unknown' UNION ALL SELECT doc_id, collection, 10 FROM types JOIN (VALUES {', '.join(f"('{k}', '{c}')" for k, c in TYPE_COLLECTIONS.items())}) AS t(kind, collection) USING (kind)
  UNION ALL SELECT doc_id, 'research', 20 FROM entries WHERE contains(stem, 'research')),
firsts AS (SELECT doc_id, collection, min(place) AS place FROM offered GROUP BY 1, 2), collections AS (SELECT doc_id, collection, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS place FROM firsts UNION ALL SELECT doc_id, 'unknown', 1 FROM entries WHERE doc_id NOT IN (SELECT doc_id FROM firsts)) """


@query("collection_assignment", COLLECTIONS_SQL + "SELECT doc_id, collection, CAST(place AS INTEGER) AS place FROM collections WHERE place <= 4")
def collection_assignment(spark, sf_dir):
    return by_collection(described(spark, sf_dir), "doc_id").select("doc_id", "collection", (F.col("at") + 1).alias("place"))


PATHS_SQL = COLLECTIONS_SQL + CONCEPTS_SQL + f""", paths AS (SELECT doc_id, concat_ws('/', CASE WHEN c.collection IN ('hr', 'it') THEN upper(c.collection) ELSE concat(upper(c.collection[1]), c.collection[2:]) END, CASE kind {' '.join(f"WHEN '{k}' THEN '{b}'" for k, b in BUCKETS.items())} ELSE 'General' END, (SELECT arg_min(concept, ord) FROM concepts x WHERE x.doc_id = c.doc_id)) AS path FROM (SELECT * FROM collections WHERE place = 1) c JOIN types USING (doc_id)) """


@query("taxonomy_paths", PATHS_SQL + "SELECT doc_id, path FROM paths")
def taxonomy_paths(spark, sf_dir):
    return described(spark, sf_dir).select("doc_id", "path")


def by_collection(e, *columns):
    """Columns of described() with at and collection, a row for each collection. Outer, as else Spark infers a filter that has all rules of the collections
    in it, several times over; rows without a collection are left out afterwards."""
    return e.select(*columns, F.posexplode_outer("collections").alias("at", "collection")).where("collection IS NOT NULL")


@query("registry_statistics", PATHS_SQL + "SELECT collection, count(*) AS n, count(*) FILTER (place = 1) AS n_first, count(DISTINCT kind) AS kinds, round(avg(score), 6) AS mean_score FROM collections JOIN types USING (doc_id) GROUP BY 1")
def registry_statistics(spark, sf_dir):
    """Documents of each collection, how many it is the first one of, and how sure their types are."""
    long = by_collection(described(spark, sf_dir), "kind")
    return long.groupBy("collection").agg(F.count("*").alias("n"), F.count_if(F.col("at") == 0).alias("n_first"), F.countDistinct("kind.name").alias("kinds"), F.round(F.avg("kind.score"), 6).alias("mean_score"))


@query("document_states", PATHS_SQL + """, s AS (SELECT doc_id, concat(stem, CASE WHEN doc_id % 11 = 0 THEN '_draft' ELSE '' END) AS name, CASE WHEN doc_id % 13 = 0 THEN 0.95 ELSE 0.2 END AS duplicate, doc_id % 4 > 0 AS latest, kind, collection, score, path FROM entries JOIN types USING (doc_id) JOIN (SELECT * FROM collections WHERE place = 1) USING (doc_id) JOIN paths USING (doc_id))
SELECT doc_id, CASE WHEN duplicate >= 0.9 THEN 'duplicate' WHEN contains(name, 'archive') THEN 'archived' WHEN contains(name, 'draft') THEN 'draft' WHEN collection = 'external' THEN 'external' WHEN NOT latest THEN 'superseded' WHEN kind = 'Unknown' OR score < 0.45 OR collection = 'unknown' THEN 'incomplete' WHEN score >= 0.78 THEN 'verified' WHEN score >= 0.6 THEN 'healthy' ELSE 'unknown' END AS state FROM s""")
def document_states(spark, sf_dir):
    d = F.col("doc_id")
    name = F.concat("stem", F.when(d % 11 == 0, "_draft").otherwise(""))
    state = K.health(name, F.when(d % 13 == 0, 0.95).otherwise(0.2), d % 4 > 0, F.col("kind.name"), F.get("collections", 0), F.col("kind.score"), F.col("path"))
    return described(spark, sf_dir).select("doc_id", state.alias("state"))


INDEXES_SQL = PATHS_SQL + """, keyword AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(stem, '[a-z0-9]+')) AS term FROM entries),
postings AS (SELECT 'metadata' AS index_name, stem AS term, doc_id FROM entries UNION SELECT 'collection', collection, doc_id FROM collections WHERE place <= 4 UNION SELECT 'department', lower(name), doc_id FROM departments UNION SELECT 'taxonomy', lower(path), doc_id FROM paths
  UNION SELECT 'entity', unnest(regexp_extract_all(text, '[a-z]{2,}-?[0-9]{2,}')), doc_id FROM entries UNION SELECT 'keyword', term, doc_id FROM keyword UNION SELECT 'topic', lower(concept), doc_id FROM concepts UNION SELECT 'tag', lower(kind), doc_id FROM types
  UNION SELECT 'relationship', lower(source), doc_id FROM entries UNION SELECT 'version', concat('v', doc_id % 4), doc_id FROM entries) """


def indexes(spark, sf_dir):
    """(index_name, term, doc_id) of ten indexes."""
    e = described(spark, sf_dir)
    words = lambda c, p: F.array_distinct(F.regexp_extract_all(c, F.lit(p), 0))
    return K.inverted(
        e, "doc_id", metadata=F.array("stem"), collection=F.col("collections"), department=F.transform("departments", lambda d: d["name"]), taxonomy=F.array("path"),
        entity=words("text", "[a-z]{2,}-?[0-9]{2,}"), keyword=words("stem", "[a-z0-9]+"), topic=F.col("concepts"), tag=F.array("kind.name"),
        relationship=F.array("source"), version=F.array(F.concat(F.lit("v"), (F.col("doc_id") % 4).cast("string"))),
    )


@query("ten_indexes", INDEXES_SQL + "SELECT index_name, count(*) AS entries, count(DISTINCT doc_id) AS documents, count(DISTINCT term) AS keys FROM postings GROUP BY 1")
def ten_indexes(spark, sf_dir):
    """Entries, documents and keys of each index."""
    return indexes(spark, sf_dir).groupBy("index_name").agg(F.count("*").alias("entries"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("term").alias("keys"))


@query("index_coverage", INDEXES_SQL + "SELECT n.index_name, d.doc_id FROM (VALUES ('topic'), ('entity')) AS n(index_name), documents d WHERE NOT EXISTS (SELECT 1 FROM postings p WHERE p.index_name = n.index_name AND p.doc_id = d.doc_id)")
def index_coverage(spark, sf_dir):
    """Documents that an index says nothing of."""
    own, d = indexes(spark, sf_dir).select("index_name", "doc_id").distinct(), table(spark, sf_dir, "documents").select("doc_id")
    every = d.withColumn("index_name", F.explode(F.array(F.lit("topic"), F.lit("entity"))))
    return every.join(own, ["index_name", "doc_id"], "left_anti").select("index_name", "doc_id")


@query("document_across_indexes", INDEXES_SQL + "SELECT doc_id, " + ", ".join(f"count(*) FILTER (index_name = '{n}') AS {n}" for n in ("collection", "department", "topic", "keyword")) + " FROM postings GROUP BY 1")
def document_across_indexes(spark, sf_dir):
    """What indexes hold of each document, in a row."""
    return indexes(spark, sf_dir).groupBy("doc_id").pivot("index_name", ["collection", "department", "topic", "keyword"]).agg(F.count("term")).na.fill(0)


ASKED_SQL = INDEXES_SQL + """, asked AS (SELECT * FROM (VALUES ('department', 'hr'), ('collection', 'finance'), ('topic', 'vpn'), ('keyword', 'policy'), ('version', 'v1'), ('metadata', 'hr_policy')) AS a(index_name, term)),
evidence AS (SELECT doc_id AS document, index_name, term FROM postings JOIN asked USING (index_name, term)) """


def evidence(spark, sf_dir):
    """(document, index_name, term, match, latest): what a plan's terms find in the indexes."""
    asked = [("department", "hr"), ("collection", "finance"), ("topic", "vpn"), ("keyword", "policy"), ("version", "v1"), ("metadata", "hr_policy")]
    found = indexes(spark, sf_dir).join(F.broadcast(spark.createDataFrame(asked, "index_name string, term string")), ["index_name", "term"])
    return found.select(F.col("doc_id").alias("document"), "index_name", "term", F.lit("exact").alias("match"), F.lit(True).alias("latest"))


_POINTS = " ".join(f"WHEN '{n}' THEN {p}::DOUBLE" for n, p in INDEX_POINTS.items() if n != "version")


@query("candidate_ranking", ASKED_SQL + f""", p AS (SELECT document, count(DISTINCT index_name) AS indexes, count(*) AS n, sum(CASE index_name WHEN 'metadata' THEN 1.5::DOUBLE WHEN 'version' THEN 1.4::DOUBLE {_POINTS} ELSE 0 END) AS points FROM evidence GROUP BY 1), s AS (SELECT document, indexes, round(least(4.0::DOUBLE, indexes) + least(2.0::DOUBLE, 0.25::DOUBLE * n) + points, 4) AS score FROM p)
SELECT document, score, round(least(0.99::DOUBLE, score / 12), 4) AS confidence, indexes FROM s ORDER BY score DESC, document LIMIT 100""")
def candidate_ranking(spark, sf_dir):
    """The hundred documents for which the indexes speak most."""
    return K.candidates(evidence(spark, sf_dir)).orderBy(F.desc("score"), "document").limit(100)


@query("evidence_merge", ASKED_SQL + ", raw AS (SELECT document, index_name, 0.1::DOUBLE * (document % 14) AS score FROM evidence UNION ALL SELECT document, index_name, 0.05::DOUBLE * (document % 9) FROM evidence), o AS (SELECT document, index_name, max(least(greatest(score, 0), 1)) AS score FROM raw GROUP BY 1, 2) SELECT document, index_name, round(score, 6) AS score, round(score / max(score) OVER (), 4) AS normalised FROM o")
def evidence_merge(spark, sf_dir):
    """Evidence of two workers without repeats, its scores against the largest."""
    e = evidence(spark, sf_dir)
    worker = lambda step, n: e.select("document", "index_name", (F.lit(step) * (F.col("document") % n)).alias("score"))
    return K.merged_evidence(worker(0.1, 14).unionByName(worker(0.05, 9)), ["document", "index_name"]).withColumn("score", F.round("score", 6))


NAMES_SQL = """WITH n AS (SELECT doc_id, concat(array_to_string((regexp_extract_all(lower(text), '[a-z]{3,}'))[1:5], '_'), CASE WHEN doc_id % 2 = 0 THEN '_v2' ELSE '_final' END, '.txt') AS name, source FROM documents),
t AS (SELECT doc_id, source, list_distinct(list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower(name), '\\.[^.]+$', ''), '(final|draft|copy|v\\d+|rev\\d+)', ' ', 'g'), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in NAME_STOPWORDS) + """))) AS terms FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.source = b.source AS same, len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms))) AS share FROM t a JOIN t b ON a.doc_id < b.doc_id AND len(list_intersect(a.terms, b.terms)) > 0) """


#: Files of one set of words that are spread out together, on average.
COPIES = 1000


@query("filename_duplicates", NAMES_SQL + "SELECT a, b, round(least(0.99::DOUBLE, share + CASE WHEN same THEN 0.15::DOUBLE ELSE 0 END), 3) AS score FROM p WHERE least(0.99::DOUBLE, share + CASE WHEN same THEN 0.15::DOUBLE ELSE 0 END) >= 0.72")
def filename_duplicates(spark, sf_dir):
    """Pairs of files whose names share most of their words; the same collection adds 0.15. Equal sets of words meet as one, so copies are
    spread out only at the end, a block of one set against a block of another, and these are dealt to all tasks. There are as many rows as pairs."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0), 1, 5)
    name = F.concat(F.array_join(words, "_"), F.when(F.col("doc_id") % 2 == 0, "_v2").otherwise("_final"), F.lit(".txt"))
    t = table(spark, sf_dir, "documents").select("doc_id", "source", F.array_sort(K.name_tokens(name)).alias("terms")).where(F.size("terms") > 0)
    t = written(t.withColumn("id", F.md5(F.array_join("terms", " "))), "names")
    sets = t.groupBy("id").agg(F.any_value("terms").alias("terms"), F.count("*").alias("n"))
    near = K.similar_sets(sets.select("id", "terms"), 57).select("x", "y", "share").unionByName(sets.select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("share")))
    block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / COPIES)).cast("int")
    own = t.join(sets.select("id", "n"), "id").groupBy("id", block.alias("block")).agg(F.collect_list(F.struct(F.col("doc_id").alias("i"), F.col("source").alias("s"))).alias("files"))
    own = written(own, "name-blocks")
    side = lambda x, p, *files: own.select(F.col("id").alias(x), F.col("block").alias(p), *[F.col("files").alias(f) for f in files])
    met = near.join(side("x", "p"), "x").join(side("y", "q"), "y").where("x <> y OR p <= q")
    met = met.join(side("x", "p", "a"), ["x", "p"]).join(side("y", "q", "b"), ["y", "q"])
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "x", "p", "y", "q")
    pairs = met.select((F.struct("x", "p") != F.struct("y", "q")).alias("apart"), "share", F.explode("a").alias("a"), "b").select("apart", "share", "a", F.explode("b").alias("b")).where("apart OR a.i < b.i")
    score = F.least(F.lit(0.99), F.col("share") + F.when(F.col("a.s") == F.col("b.s"), 0.15).otherwise(0.0))
    return pairs.where(score >= 0.72).select(F.least("a.i", "b.i").alias("a"), F.greatest("a.i", "b.i").alias("b"), F.round(score, 3).alias("score"))


CLASSES_SQL = ENTRIES_SQL + CONCEPTS_SQL + """, c AS (SELECT doc_id, array_to_string(list_sort(list(concept)), '|') AS class FROM concepts GROUP BY 1), k AS (SELECT class, string_split(class, '|') AS concepts, count(*) AS n FROM c GROUP BY 1),
p AS (SELECT a.class AS a, b.class AS b, len(list_intersect(a.concepts, b.concepts)) AS shared, CASE WHEN a.class = b.class THEN a.n * (a.n - 1) ELSE a.n * b.n END AS pairs FROM k a JOIN k b ON len(list_intersect(a.concepts, b.concepts)) > 0 AND NOT (a.class = b.class AND a.n < 2)),
r AS (SELECT a, b, 'mentions' AS type, 0.6::DOUBLE + least(0.25::DOUBLE, 0.05::DOUBLE * shared) AS confidence, pairs FROM p UNION ALL SELECT a, b, 'references', 0.62::DOUBLE + least(0.2::DOUBLE, 0.04::DOUBLE * shared), pairs FROM p UNION ALL SELECT a, b, 'related_to', 0.7::DOUBLE + least(0.2::DOUBLE, 0.05::DOUBLE * shared), pairs FROM p WHERE shared >= 2) """


def relations(spark, sf_dir):
    """(a, b, type, confidence, pairs): relations between classes of documents with the same concepts, for both directions, and how many pairs of
    documents each stands for. Classes are few, where pairs of documents would be the square of them."""
    c = entries(spark, sf_dir).select("doc_id", F.array_sort(K.concepts(F.col("text"))).alias("concepts")).where(F.size("concepts") > 0)
    k = c.groupBy("concepts").agg(F.count("*").alias("n")).withColumn("class", F.array_join("concepts", "|"))
    k = written(k, "classes")
    e = k.select("class", "n", F.explode("concepts").alias("concept"))
    x, y = e.select(F.col("class").alias("a"), F.col("n").alias("na"), "concept"), e.select(F.col("class").alias("b"), F.col("n").alias("nb"), "concept")
    p = x.join(y, "concept").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).where("a <> b OR na > 1").withColumn("pairs", F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1)).otherwise(F.col("na") * F.col("nb")))
    rule = lambda name, base, most, step, least: F.when(F.col("shared") >= least, F.struct(F.lit(name).alias("type"), (base + F.least(F.lit(most), step * F.col("shared"))).alias("confidence")))
    kinds = F.array_compact(F.array(rule("mentions", 0.6, 0.25, 0.05, 1), rule("references", 0.62, 0.2, 0.04, 1), rule("related_to", 0.7, 0.2, 0.05, 2)))
    return p.select("a", "b", F.explode(kinds).alias("r"), "pairs").select("a", "b", "r.type", "r.confidence", "pairs")


@query("concept_relations", CLASSES_SQL + "SELECT a, b, type, round(confidence, 4) AS confidence, pairs FROM r")
def concept_relations(spark, sf_dir):
    return relations(spark, sf_dir).withColumn("confidence", F.round("confidence", 4))


@query("relationship_statistics", CLASSES_SQL + "SELECT type, CASE WHEN confidence < 0.6 THEN '0.0-0.6' WHEN confidence < 0.75 THEN '0.6-0.75' WHEN confidence < 0.9 THEN '0.75-0.9' ELSE '0.9-1.0' END AS bucket, CAST(sum(pairs) AS BIGINT) AS n FROM (SELECT type, round(confidence, 4) AS confidence, pairs FROM r) GROUP BY 1, 2")
def relationship_statistics(spark, sf_dir):
    """Relations between documents by type and confidence."""
    c = F.round("confidence", 4)
    bucket = F.when(c < 0.6, "0.0-0.6").when(c < 0.75, "0.6-0.75").when(c < 0.9, "0.75-0.9").otherwise("0.9-1.0")
    return relations(spark, sf_dir).groupBy("type", bucket.alias("bucket")).agg(F.sum("pairs").alias("n"))


GRAPH_SQL = """WITH RECURSIVE edges AS (
  SELECT concat('doc:', doc_id) AS src, concat('topic:', source) AS dst, 'contains_topic' AS type, 0.5::DOUBLE + (doc_id % 5) / 10.0 AS confidence FROM documents
  UNION ALL SELECT concat('doc:', doc_id), concat('doc:', doc_id + 20), 'next_version', 0.9::DOUBLE FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT concat('doc:', doc_id), concat('doc:', doc_id + 7), 'references', 0.3::DOUBLE + (doc_id % 7) / 10.0 FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT concat('doc:', doc_id), concat('doc:', doc_id + 7), 'references', 0.2::DOUBLE FROM documents WHERE doc_id % 8 = 0
  UNION ALL SELECT concat('doc:', doc_id), concat('doc:', doc_id), 'related_to', 0.9::DOUBLE FROM documents WHERE doc_id % 50 = 0),
best AS (SELECT src, dst, type, max(confidence) AS confidence FROM edges WHERE src <> dst GROUP BY 1, 2, 3) """


def edges(spark, sf_dir):
    d, node = table(spark, sf_dir, "documents"), lambda c: F.concat(F.lit("doc:"), c.cast("string"))
    k = F.col("doc_id")
    part = lambda where, dst, kind, confidence: d.where(where).select(node(k).alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), confidence.cast("double").alias("confidence"))
    out = part("true", F.concat(F.lit("topic:"), "source"), "contains_topic", 0.5 + (k % 5) / 10.0)
    for p in (part("doc_id % 3 = 0", node(k + 20), "next_version", F.lit(0.9)), part("doc_id % 4 = 0", node(k + 7), "references", 0.3 + (k % 7) / 10.0), part("doc_id % 8 = 0", node(k + 7), "references", F.lit(0.2)), part("doc_id % 50 = 0", node(k), "related_to", F.lit(0.9))):
        out = out.unionByName(p)
    return out


@query("best_edges", GRAPH_SQL + "SELECT src, dst, type, round(confidence, 6) AS confidence FROM best")
def best_edges(spark, sf_dir):
    """One edge for each pair of ends and type, the surest; no loops."""
    return G.best_edges(edges(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("dangling_edges", GRAPH_SQL + "SELECT DISTINCT src, dst, type FROM best WHERE dst LIKE 'doc:%' AND CAST(substr(dst, 5) AS BIGINT) NOT IN (SELECT doc_id FROM documents)")
def dangling_edges(spark, sf_dir):
    """Edges to documents that there are not."""
    d = table(spark, sf_dir, "documents")
    nodes = d.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node")).union(d.select(F.concat(F.lit("topic:"), "source")).distinct())
    return G.dangling(G.best_edges(edges(spark, sf_dir)), nodes).select("src", "dst", "type").distinct()


@query("graph_health", GRAPH_SQL + "SELECT count(*) AS edges, count(*) FILTER (confidence < 0.4) AS weak, (SELECT count(*) FROM documents WHERE concat('doc:', doc_id) NOT IN (SELECT src FROM best WHERE type <> 'contains_topic' UNION ALL SELECT dst FROM best WHERE type <> 'contains_topic')) AS orphans FROM best")
def graph_health(spark, sf_dir):
    """Edges, weak ones, and documents without any edge but to their topic."""
    own = G.best_edges(edges(spark, sf_dir))
    linked = own.where("type <> 'contains_topic'")
    ends = linked.select("src").union(linked.select("dst")).distinct().withColumnRenamed("src", "node")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node"))
    alone = F.broadcast(docs.join(ends, "node", "left_anti").agg(F.count("*").alias("orphans")))
    return own.agg(F.count("*").alias("edges"), F.count_if(F.col("confidence") < 0.4).alias("weak")).join(alone)


_MODES = ", ".join(f"('{m}', '{t}')" for m, ts in EXPANSIONS.items() for t in ts)
_WEIGHTS = " ".join(f"WHEN '{t}' THEN {w}::DOUBLE" for t, w in EDGE_WEIGHTS.items())


@query("graph_expansion", GRAPH_SQL + f""", mode AS (SELECT * FROM (VALUES {_MODES}) AS m(mode, type)), way AS (SELECT DISTINCT mode, src, dst, type, confidence FROM best JOIN mode USING (type) WHERE confidence >= 0.4),
walk(mode, node, depth) AS (SELECT DISTINCT mode, 'doc:12', 0 FROM mode UNION SELECT w.mode, dst, depth + 1 FROM walk w JOIN way y ON y.mode = w.mode AND y.src = w.node WHERE depth < 3),
reached AS (SELECT mode, node, min(depth) AS depth FROM walk GROUP BY 1, 2)
SELECT r.mode, r.node, r.depth, max(round(y.confidence * CASE y.type {_WEIGHTS} ELSE 0.8::DOUBLE END / (1 + r.depth), 4)) AS score FROM reached r JOIN reached f ON f.mode = r.mode AND f.depth = r.depth - 1 JOIN way y ON y.mode = r.mode AND y.src = f.node AND y.dst = r.node GROUP BY 1, 2, 3""")
def graph_expansion(spark, sf_dir):
    """What each mode of expansion reaches from a document in three steps, scored by the edge that leads there."""
    return G.expanded(G.best_edges(edges(spark, sf_dir)), spark.createDataFrame([("doc:12",)], "node string"), 3, 0.4).select("mode", "node", "depth", "score")


@query("replaced_edges", GRAPH_SQL + "SELECT src, dst, type FROM best WHERE src <> 'doc:0' AND src <> 'doc:12' UNION ALL SELECT 'doc:12', 'doc:1', 'extends'")
def replaced_edges(spark, sf_dir):
    """All edges of two sources replaced by new ones, of which the first has none."""
    own = G.best_edges(edges(spark, sf_dir)).select("src", "dst", "type")
    new = spark.createDataFrame([("doc:12", "doc:1", "extends")], own.schema)
    return G.replaced(own, spark.createDataFrame([("doc:0",), ("doc:12",)], "src string"), new)
