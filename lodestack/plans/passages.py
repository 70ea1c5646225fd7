"""Passages of documents: words, titles, questions, page furniture, lists and tables, claims, and how questions are understood."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import fixed as V
from lodestack.functions import text as X
from lodestack.functions.bindings import DOCS_SQL, MESSAGES_SQL, documents, messages
from lodestack.operators import blocks as B
from lodestack.operators import chunks as C
from lodestack.operators import ingestion as I
from lodestack.operators import passages as A
from lodestack.operators import planning as P
from lodestack.operators import retrieval as R
from lodestack.plans import retrieval as S
from lodestack.plans.planning import QUESTIONS_SQL, questions
from lodestack.plans.registry import query
from lodestack.session import table
from lodestack.shared import written

_Q = lambda s: s.replace("'", "''")
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query("grounding_words", f"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all({X.folded_sql('text')}, '[a-z0-9]{{4,}}'), lambda w: w NOT IN ({_IN(V.GROUNDING_STOPWORDS)})))) AS n, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'))) AS n_short FROM documents")
def grounding_words(spark, sf_dir):
    """How many different words count when an answer is held against a text, and those of three letters."""
    long = F.regexp_extract_all(X.folded(F.col("text")), F.lit("[a-z0-9]{4,}"), 0)
    kept = F.array_distinct(F.filter(long, lambda w: ~w.isin(*V.GROUNDING_STOPWORDS)))
    short = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), 0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kept).cast("long").alias("n"), F.size(short).cast("long").alias("n_short"))


@query("question_terms", QUESTIONS_SQL + f"SELECT conversation_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{3,}}')), lambda w: lower(w)), lambda w: w NOT IN ({_IN(V.QUESTION_STOPWORDS)})))), ' ') AS terms FROM questions")
def question_terms(spark, sf_dir):
    words = F.transform(F.filter(F.regexp_extract_all("q", F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: w.rlike("^[a-zA-Z]{3,}$")), F.lower)
    return questions(spark, sf_dir).select("conversation_id", "turn", F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*V.QUESTION_STOPWORDS)))), " ").alias("terms"))


@query("metadata_basics", f"WITH {DOCS_SQL}, w AS (SELECT doc_id, filename, length(text) AS n_chars, len({X.named_words_sql('text')}) AS n_words, list_max(list_transform(regexp_extract_all(text, '<<<PAGE:([0-9]+)>>>', 1), lambda x: CAST(x AS INTEGER))) AS marked FROM docs) SELECT doc_id, regexp_extract(lower(filename), '\\.([^.]+)$', 1) AS extension, n_chars, n_words, CAST(coalesce(marked, greatest(1, (n_words + 499) // 500)) AS BIGINT) AS pages FROM w")
def metadata_basics(spark, sf_dir):
    """Extension, size, words and pages: the largest page mark, or else 500 words a page."""
    n = F.size(X.named_words(F.col("text"))).cast("long")
    marked = F.array_max(F.transform(F.regexp_extract_all("text", F.lit("<<<PAGE:([0-9]+)>>>"), 1), lambda x: x.cast("long")))
    pages = F.coalesce(marked, F.greatest(F.lit(1).cast("long"), F.ceil(n / 500)))
    return documents(spark, sf_dir).select("doc_id", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).alias("extension"), F.length("text").cast("long").alias("n_chars"), n.alias("n_words"), pages.alias("pages"))


@query("first_lines", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '' AND NOT regexp_full_match(l, '[=_*-]+'))[1:8], ' / ') AS lines FROM documents")
def first_lines(spark, sf_dir):
    """The first eight lines that are neither blank nor rules."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^[=_*-]+$"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(lines, 1, 8), " / ").alias("lines"))


TITLED_SQL = "WITH h AS (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'the KYC ' WHEN 1 THEN 'FY2026 ' WHEN 2 THEN 'is this ' ELSE 'Loan ' END, array_to_string((regexp_extract_all(text, '[a-zA-Z]{2,}'))[1:2 + doc_id % 6], ' '), CASE doc_id % 5 WHEN 0 THEN '?' WHEN 1 THEN '.:' ELSE '' END) AS heading, source FROM documents) "
_TITLE = "CASE WHEN regexp_matches({0}, '\\d|^.+[A-Z]') THEN {0} ELSE concat(upper({0}[1]), lower({0}[2:])) END"
_LOW = "CASE WHEN regexp_matches({0}, '\\d|^.+[A-Z]') THEN {0} ELSE concat(lower({0}[1]), {0}[2:]) END"


def headings(spark, sf_dir):
    """doc_id, heading, source: headings made of the first words of texts."""
    k, m = F.col("doc_id") % 4, F.col("doc_id") % 5
    opening = F.when(k == 0, "the KYC ").when(k == 1, "FY2026 ").when(k == 2, "is this ").otherwise("Loan ")
    words = F.slice(F.regexp_extract_all("text", F.lit("[a-zA-Z]{2,}"), 0), F.lit(1), (F.lit(2) + F.col("doc_id") % 6).cast("int"))
    tail = F.when(m == 0, "?").when(m == 1, ".:").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(opening, F.array_join(words, " "), tail).alias("heading"), "source")


@query("title_case", TITLED_SQL + f", w AS (SELECT doc_id, regexp_extract_all(heading, '[A-Za-z0-9]+') AS w FROM h), k AS (SELECT doc_id, list_filter(w, lambda x: lower(x) NOT IN ({_IN(V.QUESTION_STOPWORDS)})) AS k, w FROM w) SELECT doc_id, array_to_string(list_transform((CASE WHEN len(k) > 0 THEN k ELSE w END)[1:6], lambda x: {_TITLE.format('x')}), ' ') AS title FROM k")
def title_case(spark, sf_dir):
    """Titles of up to six telling words, each with a capital unless it is an acronym or has digits."""
    w = F.regexp_extract_all("heading", F.lit("[A-Za-z0-9]+"), 0)
    k = F.filter(w, lambda x: ~F.lower(x).isin(*V.QUESTION_STOPWORDS))
    return headings(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.slice(F.when(F.size(k) > 0, k).otherwise(w), 1, 6), A.title_word), " ").alias("title"))


@query("heading_questions", TITLED_SQL + f""", p AS (SELECT doc_id, source, regexp_replace(trim(heading), '[.:]+$', '') AS plain FROM h), l AS (SELECT *, string_split(plain, ' ') AS w, array_to_string(list_transform(string_split(plain, ' '), lambda x: {_LOW.format('x')}), ' ') AS low FROM p)
SELECT doc_id, CASE WHEN plain = '' THEN concat('What does ', source, ' cover?') WHEN ends_with(plain, '?') THEN plain WHEN len(w) <= 5 THEN concat('Explain ', CASE WHEN regexp_matches(low, '^(the|a|an) ') THEN '' ELSE 'the ' END, low, '.') ELSE concat('What does the ', source, ' document say about ', low, '?') END AS question FROM l""")
def heading_questions(spark, sf_dir):
    return headings(spark, sf_dir).select("doc_id", A.question_of(F.col("heading"), F.col("source")).alias("question"))


@query("heading_weighted_text", TITLED_SQL + "SELECT doc_id, md5(concat(heading, chr(10), heading, chr(10), chr(10), text)) AS digest FROM h JOIN documents USING (doc_id)")
def heading_weighted_text(spark, sf_dir):
    """Texts to embed and index: the heading twice, then the body."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return headings(spark, sf_dir).join(d, "doc_id").select("doc_id", F.md5(X.heading_weighted(F.col("heading"), F.col("text"))).alias("digest"))


@query("capital_headings", TITLED_SQL + ", c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(heading) ELSE heading END AS line FROM h), n AS (SELECT doc_id, line, regexp_replace(line, '[^A-Za-z]', '', 'g') AS letters FROM c) SELECT doc_id FROM n WHERE length(letters) >= 3 AND length(regexp_replace(letters, '[^A-Z]', '', 'g')) >= length(letters) * 0.85 AND len(string_split(trim(line), ' ')) <= 12")
def capital_headings(spark, sf_dir):
    """Headings in capitals: 85 % of the letters, up to twelve words."""
    line = F.when(F.col("doc_id") % 3 == 0, F.upper("heading")).otherwise(F.col("heading"))
    return headings(spark, sf_dir).where(I.capitals(line)).select("doc_id")


IDS_SQL = "WITH t AS (SELECT doc_id, concat('see GT-HR-', 10 + doc_id % 90, ' and AB-C1-D2-', doc_id, ', not A-12, ', text) AS text FROM documents) "


@query("document_ids", IDS_SQL + f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{V.DOCUMENT_ID}'))), ' ') AS ids FROM t")
def document_ids(spark, sf_dir):
    """Identifiers of documents that a text names."""
    d = F.col("doc_id")
    text = F.concat(F.lit("see GT-HR-"), (d % 90 + 10).cast("string"), F.lit(" and AB-C1-D2-"), d.cast("string"), F.lit(", not A-12, "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(V.DOCUMENT_ID), 0))), " ").alias("ids"))


@query("label_prose", rf"WITH l AS (SELECT doc_id, concat('Source ', source, ' : ', lang, ' text..') AS line, 'too long label ' || repeat('x', 60) || ': value' AS other FROM documents), x AS (SELECT doc_id, line FROM l UNION ALL SELECT doc_id, other FROM l), p AS (SELECT doc_id, trim(regexp_extract(trim(line), '^(.+?):\s*(.+)$', 1)) AS label, regexp_replace(trim(regexp_extract(trim(line), '^(.+?):\s*(.+)$', 2)), '\.+$', '') AS value FROM x) SELECT doc_id, concat(label, ' is ', value, '.') AS prose FROM p WHERE label <> '' AND length(label) <= 60 AND length(value) >= 3")
def label_prose(spark, sf_dir):
    """Lines of a label and a value as sentences."""
    line = F.concat(F.lit("Source "), "source", F.lit(" : "), "lang", F.lit(" text.."))
    both = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(line, F.lit("too long label " + "x" * 60 + ": value"))).alias("line"))
    return both.select("doc_id", A.prose_of(F.col("line")).alias("prose")).where("prose IS NOT NULL")


PAGES_SQL = "WITH paged AS (SELECT doc_id, concat('<<<PAGE:1>>>', chr(10), 'ACME Handbook ', source, chr(10), text, chr(10), 'Page 1 of 3', chr(10), '<<<PAGE:2>>>', chr(10), 'ACME Handbook ', source, chr(10), 'Body ', doc_id, chr(10), 'Confidential', chr(10), 'Version 1.', doc_id % 7, chr(10), '<<<PAGE:3>>>', chr(10), 'Last words', chr(10), chr(10), 'ACME Handbook ', source, chr(10), '3 / 3') AS text FROM documents), "
LINES_SQL = PAGES_SQL + "raw AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM paged)), marked AS (SELECT *, TRY_CAST(nullif(regexp_extract(line, '^<<<PAGE:([0-9]+)>>>$', 1), '') AS INTEGER) AS mark FROM raw), lines AS (SELECT doc_id, pos, line, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 1) AS page, mark FROM marked QUALIFY mark IS NULL) "


def paged(spark, sf_dir):
    """doc_id, text: documents of three pages with headers and footers."""
    d, nl = table(spark, sf_dir, "documents"), "\n"
    parts = [f"<<<PAGE:1>>>{nl}ACME Handbook ", "source", nl, "text", f"{nl}Page 1 of 3{nl}<<<PAGE:2>>>{nl}ACME Handbook ", "source", f"{nl}Body ", "doc_id", f"{nl}Confidential{nl}Version 1.", "version", f"{nl}<<<PAGE:3>>>{nl}Last words{nl}{nl}ACME Handbook ", "source", f"{nl}3 / 3"]
    columns = [F.col(p).cast("string") if p in ("source", "text", "doc_id", "version") else F.lit(p) for p in parts]
    return d.withColumn("version", F.col("doc_id") % 7).select("doc_id", F.concat(*columns).alias("text"))


@query("page_lines", LINES_SQL + "SELECT doc_id, page, count(*) AS n FROM lines GROUP BY 1, 2")
def page_lines(spark, sf_dir):
    """Lines of each page by the page marks."""
    return I.lines(paged(spark, sf_dir)).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query("page_number_lines", LINES_SQL + "SELECT doc_id, count(*) AS n FROM lines WHERE " + " OR ".join(f"regexp_matches(trim(line), '(?i){p}')" for p in V.NUMBER_LINES) + " GROUP BY 1")
def page_number_lines(spark, sf_dir):
    return I.lines(paged(spark, sf_dir)).where(I.number_line(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("boilerplate_removal", LINES_SQL + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS top, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS bottom, regexp_replace(regexp_replace(lower(trim(line)), '\\s+', ' ', 'g'), '[0-9]+', '{{page}}', 'g') AS key FROM lines),
pages AS (SELECT doc_id, count(DISTINCT page) AS pages FROM lines GROUP BY 1), common AS (SELECT doc_id, key FROM placed JOIN pages USING (doc_id) WHERE (top <= 4 OR bottom <= 3) AND trim(line) <> '' GROUP BY doc_id, key, pages HAVING count(DISTINCT page) >= greatest(2, floor(pages * 0.4)))
SELECT p.doc_id, count(*) AS n, count(*) FILTER (NOT (((top <= 4 OR bottom <= 3) AND c.key IS NOT NULL) OR {I.structural_sql('line')})) AS kept FROM placed p LEFT JOIN common c ON c.doc_id = p.doc_id AND c.key = p.key GROUP BY 1""")
def boilerplate_removal(spark, sf_dir):
    """Lines before and after headers, footers and furniture are taken out."""
    rows = I.lines(paged(spark, sf_dir))
    kept = I.without_boilerplate(rows).groupBy("doc_id").agg(F.count("*").alias("kept"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(kept, "doc_id", "left").select("doc_id", "n", F.coalesce("kept", F.lit(0)).alias("kept"))


SHAPED_SQL = "WITH shaped AS (SELECT doc_id, concat(text, chr(10), chr(10), '- one', chr(10), '  - two', chr(10), '    - three ', source, chr(10), '- four', chr(10), '1. first', chr(10), '2. second', chr(10), chr(10), 'Name  Count  Share', chr(10), 'Alpha  ', doc_id % 10, '  5', chr(10), 'Beta  7  ', doc_id % 3, chr(10), 'Gamma  ', CASE WHEN doc_id % 5 = 0 THEN repeat('long prose that goes on. ', 9) ELSE '1' END, '  2', chr(10), '2. Closing  words  here', chr(10), 'Two  cells') AS text FROM documents), raw AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM shaped)) "


def shaped(spark, sf_dir):
    """Lines of documents with lists and a table at their end."""
    nl = "\n"
    d = table(spark, sf_dir, "documents").withColumns({"a": F.col("doc_id") % 10, "b": F.col("doc_id") % 3, "c": F.when(F.col("doc_id") % 5 == 0, "long prose that goes on. " * 9).otherwise("1")})
    parts = ["text", f"{nl}{nl}- one{nl}  - two{nl}    - three ", "source", f"{nl}- four{nl}1. first{nl}2. second{nl}{nl}Name  Count  Share{nl}Alpha  ", "a", f"  5{nl}Beta  7  ", "b", f"{nl}Gamma  ", "c", f"  2{nl}2. Closing  words  here{nl}Two  cells"]
    text = F.concat(*[F.col(p).cast("string") if p in ("text", "source", "a", "b", "c") else F.lit(p) for p in parts])
    return I.lines(d.select("doc_id", text.alias("text")))


@query("nested_lists", SHAPED_SQL + f""", k AS (SELECT doc_id, pos, CASE WHEN regexp_matches(trim(line), '{V.BULLET}') THEN false WHEN regexp_matches(trim(line), '{V.ORDERED}') THEN true END AS ordered, (length(line) - length(ltrim(line, ' '))) // 2 AS level FROM raw), m AS (SELECT *, ordered IS NOT NULL AND level <= 6 AS own FROM k),
s AS (SELECT *, CASE WHEN own AND (NOT coalesce(lag(own) OVER w, false) OR lag(ordered) OVER w IS DISTINCT FROM ordered) THEN 1 ELSE 0 END AS starts FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), r AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM s)
SELECT doc_id, min(pos) AS start, bool_or(ordered) AS ordered, count(*) AS items, CAST(max(level) AS INTEGER) AS depth FROM r WHERE own GROUP BY doc_id, run""")
def nested_lists(spark, sf_dir):
    """Lists of documents: where they begin, their kind, items and depth."""
    return A.lists(shaped(spark, sf_dir)).select("doc_id", F.col("start").cast("long").alias("start"), "ordered", "items", "depth")


_STEP = "CASE WHEN {0} <= {1} THEN 1.0::DOUBLE WHEN {0} <= {2} THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END"
_OFF = lambda c, *steps: "CASE " + " ".join(f"WHEN {c} >= {a} THEN {b}::DOUBLE" for a, b in steps) + " ELSE 0.0::DOUBLE END"
_WORDS = r"len(regexp_split_to_array(cell, '\s+'))"
_PROSE = rf"(length(cell) > 100 OR len(regexp_extract_all(cell, '\. ')) >= 2 OR (regexp_matches(cell, '[.!?]') AND {_WORDS} > 12))"
TABLES_SQL = SHAPED_SQL + rf""", cut AS (SELECT doc_id, pos, line, list_filter(list_transform(regexp_split_to_array(trim(line), '\s{{2,}}'), lambda c: trim(c)), lambda c: c <> '') AS cells FROM raw), sized AS (SELECT *, CASE WHEN trim(line) = '' THEN -1 ELSE len(cells) END AS n FROM cut),
s AS (SELECT *, CASE WHEN n >= 2 AND (coalesce(lag(n) OVER w, -1) < 2 OR lag(n) OVER w <> n OR regexp_matches(trim(line), '(?i){V.BOUNDARY}')) THEN 1 ELSE 0 END AS starts FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), r AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM s QUALIFY n >= 2),
whole AS (SELECT doc_id, run, min(pos) AS start, max(pos) AS stop, arg_min(cells, pos) AS headers, count(*) - 1 AS data_rows FROM r GROUP BY 1, 2), good AS (SELECT * FROM whole WHERE data_rows >= 2 AND len(list_filter(headers, lambda x: length(x) > 50 OR (contains(x, ';') AND length(x) > 30) OR (ends_with(x, '.') AND len(regexp_split_to_array(x, '\s+')) > 6))) = 0),
long AS (SELECT doc_id, run, pos, pos = start AS head, unnest(range(len(cells))) AS col, unnest(cells) AS cell FROM r JOIN good g USING (doc_id, run)), f AS (SELECT *, length(cell) AS n, {_WORDS} AS words, len(regexp_extract_all(cell, '[,.;:!?]')) / length(cell) AS marks, {_PROSE} AS prose, regexp_matches(cell, '\d') AS digit, ((contains(cell, ';') AND length(cell) > 35) OR (contains(lower(cell), ' while ') AND length(cell) > 60) OR contains(lower(cell), ' reflects ')) AS narrative FROM long),
c AS (SELECT doc_id, run, avg(greatest(0, 1 - CASE WHEN n > 50 THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN prose THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN marks > 0.08 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN words > 8 THEN 0.2::DOUBLE ELSE 0 END)) FILTER (head) AS likeness, avg(n) AS mean, avg(digit::INT) FILTER (NOT head) AS numbers, avg((n > 80)::INT) AS long, avg(prose::INT) AS prose, avg(narrative::INT) AS narrative, avg((marks > 0.06)::INT) AS marked, max(col) + 1 AS columns FROM f GROUP BY 1, 2),
a AS (SELECT doc_id, run, avg(a) AS aligned FROM (SELECT doc_id, run, col, {_STEP.format('stddev_pop(n) / avg(n)', 0.35, 0.7)} AS a FROM f WHERE NOT head GROUP BY 1, 2, 3) GROUP BY 1, 2),
l AS (SELECT doc_id, run, {_STEP.format('stddev_pop(words) / avg(words)', 0.45, 0.9)} AS even, stddev_pop(width) / avg(width) AS uneven, avg((width > 220)::INT) AS oversized FROM (SELECT doc_id, run, pos, sum(words) AS words, sum(n) AS width FROM f WHERE NOT head GROUP BY 1, 2, 3) GROUP BY 1, 2),
scored AS (SELECT g.doc_id, g.run, start, columns, data_rows, round(least(1, greatest(0, 0.22::DOUBLE * likeness + CASE WHEN mean <= 28 THEN 0.2::DOUBLE WHEN mean <= 45 THEN 0.15::DOUBLE WHEN mean <= 70 THEN 0.08::DOUBLE ELSE -0.1::DOUBLE END + 0.18::DOUBLE * aligned + 0.15::DOUBLE * even + 0.1::DOUBLE * CASE WHEN numbers >= 0.35 THEN 1.0::DOUBLE WHEN numbers >= 0.15 THEN 0.6::DOUBLE ELSE 0 END + 0.1::DOUBLE
  - {_OFF('long', (0.25, 0.25))} - {_OFF('prose', (0.20, 0.30))} - {_OFF('prose', (0.40, 0.20))} - {_OFF('narrative', (0.20, 0.35), (0.10, 0.18))} - {_OFF('marked', (0.35, 0.25), (0.20, 0.12))} - {_OFF('uneven', (1.0, 0.20), (0.7, 0.10))} - {_OFF('oversized', (0.30, 0.20))})), 6) AS confidence FROM good g JOIN c USING (doc_id, run) JOIN a USING (doc_id, run) JOIN l USING (doc_id, run)) """


@query("gap_tables", TABLES_SQL + "SELECT doc_id, start, columns, data_rows, round(confidence, 4) AS confidence FROM scored WHERE confidence >= 0.55")
def gap_tables(spark, sf_dir):
    """Tables of cells with gaps between them, and how sure they are."""
    found = A.tables(shaped(spark, sf_dir)).where(F.col("confidence") >= V.TABLE_CONFIDENCE)
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("columns").cast("long").alias("columns"), "data_rows", F.round("confidence", 4).alias("confidence"))


@query("rendered_tables", TABLES_SQL + "SELECT doc_id, start, md5(string_agg(array_to_string(list_transform(range(1, len(headers) + 1), lambda i: concat(headers[i], ':', chr(10), cells[i])), chr(10) || chr(10)), chr(10) || chr(10) ORDER BY pos)) AS digest FROM scored JOIN good USING (doc_id, run, start) JOIN r USING (doc_id, run) WHERE confidence >= 0.55 AND pos > start GROUP BY 1, 2")
def rendered_tables(spark, sf_dir):
    """Tables as text to embed: for each row, each heading with its cell."""
    rows = shaped(spark, sf_dir)
    found = A.tables(rows).where(F.col("confidence") >= V.TABLE_CONFIDENCE).select("doc_id", "run", "start", "headers")
    body = A.gap_rows(rows).join(found, ["doc_id", "run"]).where(F.col("at") > F.col("start"))
    shown = F.array_join(F.zip_with("headers", "cells", lambda h, c: F.concat(h, F.lit(":\n"), c)), "\n\n")
    per = body.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", shown.alias("t")))).alias("rows"))
    return per.select("doc_id", F.col("start").cast("long").alias("start"), F.md5(F.array_join(F.col("rows.t"), "\n\n")).alias("digest"))


def stacked(spark, sf_dir):
    """Lines of documents with two stacked tables at their end, one of two columns and one of three, beside a table with gaps."""
    nl, d = "\n", table(spark, sf_dir, "documents")
    parts = ["text", f"{nl}{nl}Owner{nl}Share{nl}Ann Lee{nl}40{nl}Bo Chi{nl}60{nl}", F.concat(F.lit("Cy "), "source"), f"{nl}", (F.col("doc_id") % 90).cast("string"), f"{nl}{nl}Item{nl}Code{nl}Price{nl}Pen{nl}A1{nl}3{nl}Cup{nl}B2{nl}7{nl}{nl}1. one{nl}2. two{nl}{nl}Name  Count{nl}Alpha  1{nl}Beta  2{nl}Gamma  3"]
    return I.lines(d.select("doc_id", F.concat(*[F.lit(p) if isinstance(p, str) and p != "text" else F.coalesce("text", F.lit("")) if isinstance(p, str) else p for p in parts]).alias("text")))


def all_tables(rows):
    """Tables with gaps, then stacked ones in the lines that are left."""
    gaps = A.tables(rows).where(F.col("confidence") >= V.TABLE_CONFIDENCE).select("doc_id", "start", "end", "columns", "data_rows", "confidence")
    gaps = written(gaps, "gap-tables")
    return gaps, A.stacked_tables(rows, gaps, V.TABLE_CONFIDENCE)


@query("stacked_tables")
def stacked_tables(spark, sf_dir):
    """Tables whose cells stand one below the other."""
    found = all_tables(stacked(spark, sf_dir))[1]
    return found.select("doc_id", "start", "end", "columns", "data_rows", F.round("confidence", 4).alias("confidence"))


@query("document_blocks")
def document_blocks(spark, sf_dir):
    """Headings, tables, lists and paragraphs of documents, each line in one of them."""
    rows = stacked(spark, sf_dir)
    gaps, below = all_tables(rows)
    return A.blocks(I.headings(rows), gaps.select("doc_id", "start", "end").unionByName(below.select("doc_id", "start", "end")), A.lists(rows))


def document_units(rows):
    """Headings, paragraphs, items and rows of tables of lines of documents."""
    gaps, below = all_tables(rows)
    spans = gaps.select("doc_id", "start", "end", "columns", F.lit(False).alias("stacked")).unionByName(below.select("doc_id", "start", "end", "columns", F.lit(True).alias("stacked")))
    return C.units(I.headings(rows), written(spans, "tables"), A.lists(rows))


@query("semantic_chunks")
def semantic_chunks(spark, sf_dir):
    """Chunks of documents with headings beside what they head, and tables and lists whole or cut between rows and items."""
    return C.semantic_chunks(document_units(stacked(spark, sf_dir)))


@query("chunk_sizes")
def chunk_sizes(spark, sf_dir):
    """How long chunks of each kind are."""
    n = F.length("content")
    return semantic_chunks(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"))


@query("block_faults")
def block_faults(spark, sf_dir):
    """For each document, what is wrong with its blocks and chunks: overlaps, disorder, repeats, and words that got lost."""
    rows = stacked(spark, sf_dir)
    units = written(document_units(rows), "units")
    chunks = written(C.semantic_chunks(units), "chunks")
    spans = chunks.select("doc_id", "start", "end", F.col("chunk").alias("order"), F.col("chunk_id").alias("name"))
    whole = rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "line")))["line"], "\n").alias("text"))
    lost = lambda parts, name, text="text": C.missing_words(whole, parts.withColumnRenamed(text, "text"), "doc_id").withColumnRenamed("missing", name)
    found = whole.select("doc_id").join(C.span_faults(spans), "doc_id", "left").join(lost(units, "blocks_miss"), "doc_id").join(lost(chunks, "chunks_miss", "content"), "doc_id")
    return found.na.fill(0).withColumn("lossy", (F.col("blocks_miss") > C.BLOCK_LOSS) | (F.col("chunks_miss") > C.CHUNK_LOSS))


@query("evidence_links")
def evidence_links(spark, sf_dir):
    """Each block's heading above it, and the block after it."""
    return A.links(document_blocks(spark, sf_dir)).select("doc_id", "start", "kind", "parent", "next")


@query("structure_kinds", f"WITH {MESSAGES_SQL}, c AS (SELECT conversation_id, turn, CASE WHEN turn % 3 = 0 THEN concat(['approval path ', 'if a then ', 'core values ', 'L2 of ', 'for example '][1 + conversation_id % 5], content) ELSE content END AS content FROM messages) SELECT kind, count(*) AS n FROM (SELECT {P.rules_sql('content', [(n, (p,)) for n, p in V.STRUCTURES], 'general')} AS kind FROM c) GROUP BY 1")
def structure_kinds(spark, sf_dir):
    """What kind of structure passages have, by the first rule that matches."""
    opening = F.get(F.array(*[F.lit(x) for x in ("approval path ", "if a then ", "core values ", "L2 of ", "for example ")]), (F.col("conversation_id") % 5).cast("int"))
    c = messages(spark, sf_dir).select(F.when(F.col("turn") % 3 == 0, F.concat(opening, "content")).otherwise(F.col("content")).alias("content"))
    return c.groupBy(P.first_of(F.col("content"), [(n, (p,)) for n, p in V.STRUCTURES], "general").alias("kind")).agg(F.count("*").alias("n"))


@query("answer_types", QUESTIONS_SQL + f"SELECT {P.rules_sql('lower(trim(q))', [(n, (p,)) for n, p in V.ANSWERS], 'explanation')} AS kind, count(*) AS n FROM questions GROUP BY 1".replace("what'?s", "what''?s"))
def answer_types(spark, sf_dir):
    """How answers to questions should be laid out."""
    return questions(spark, sf_dir).groupBy(P.first_of(F.lower(F.trim("q")), [(n, (p,)) for n, p in V.ANSWERS], "explanation").alias("kind")).agg(F.count("*").alias("n"))


@query("query_intent", QUESTIONS_SQL + f"SELECT conversation_id, turn, {P.rules_sql('trim(q)', V.INTENTS, 'general')} AS intent FROM questions")
def query_intent(spark, sf_dir):
    return questions(spark, sf_dir).select("conversation_id", "turn", P.intent(F.col("q")).alias("intent"))


# Word borders there know ASCII only, so letters and digits beyond it are made plain ones.
_PLAIN = r"regexp_replace(q, '[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{Nd}]', 'x', 'g')"
_HITS = lambda ps: " + ".join(f"CASE WHEN regexp_matches(p, '(?i){_Q(p)}') THEN 1 ELSE 0 END" for p in ps)
PLAN_SQL = QUESTIONS_SQL + ", hit AS (" + " UNION ALL ".join(f"SELECT conversation_id, turn, {i} AS ord, '{n}' AS intent, {b}::DOUBLE AS base, {_HITS(ps)} AS n FROM (SELECT *, {_PLAIN} AS p FROM questions)" for i, (n, b, ps) in enumerate(V.PLAN_INTENTS)) + "), s AS (SELECT *, round(least(0.99::DOUBLE, base + 0.03::DOUBLE * (n - 1)), 3) AS confidence FROM hit WHERE n > 0) "


@query("plan_intents", PLAN_SQL + "SELECT conversation_id, turn, intent, confidence, CAST(row_number() OVER w AS INTEGER) AS place FROM s QUALIFY row_number() OVER w <= 5 WINDOW w AS (PARTITION BY conversation_id, turn ORDER BY confidence DESC, ord)".replace("QUALIFY row_number() OVER w <= 5 WINDOW w AS (PARTITION BY conversation_id, turn ORDER BY confidence DESC, ord)", "WINDOW w AS (PARTITION BY conversation_id, turn ORDER BY confidence DESC, ord) QUALIFY row_number() OVER w <= 5"))
def plan_intents(spark, sf_dir):
    """Up to five intents of each question that has any, the surest first."""
    q = questions(spark, sf_dir)
    return q.select("conversation_id", "turn", F.posexplode(P.plan_intents(F.col("q"))).alias("at", "i")).select("conversation_id", "turn", "i.intent", "i.confidence", (F.col("at") + 1).alias("place"))


_ROWS = lambda rows: ", ".join("(" + ", ".join(str(x) if not isinstance(x, str) else f"'{x}'" for x in r) + ")" for r in rows)


@query("strategy_weights", QUESTIONS_SQL + f", c AS (SELECT conversation_id, turn, {P.rules_sql('trim(q)', V.CATEGORIES, 'general')} AS category FROM questions), s AS (SELECT * FROM (VALUES {_ROWS([(n, *v) for n, v in V.STRATEGIES.items()])}) AS s(category, sparse, dense, bonus, pool, depth)) SELECT conversation_id, turn, category, round(0.5::DOUBLE * coalesce(dense, 1) / (0.5::DOUBLE * coalesce(dense, 1) + 0.5::DOUBLE * coalesce(sparse, 1)), 6) AS dense_weight, round(0.15::DOUBLE * coalesce(bonus, 1), 6) AS most_bonus, CAST(coalesce(pool, 20) AS INTEGER) AS pool FROM c LEFT JOIN s USING (category)")
def strategy_weights(spark, sf_dir):
    """Weights of the search by the category of the question."""
    dim = spark.createDataFrame([(n, float(s), float(d), float(b), p) for n, (s, d, b, p, _) in V.STRATEGIES.items()], "category string, sparse double, dense double, bonus double, pool int")
    q = questions(spark, sf_dir).select("conversation_id", "turn", P.category(F.col("q")).alias("category")).join(F.broadcast(dim), "category", "left")
    one = lambda c: F.coalesce(c, F.lit(1.0))
    return q.select("conversation_id", "turn", "category", F.round(0.5 * one("dense") / (0.5 * one("dense") + 0.5 * one("sparse")), 6).alias("dense_weight"), F.round(0.15 * one("bonus"), 6).alias("most_bonus"), F.coalesce("pool", F.lit(20)).alias("pool"))


_ACRONYMS = ", ".join(f"CASE WHEN regexp_matches(q, '(?i)\\b{a}\\b') AND NOT contains(lower(q), '{x}') THEN '{x}' END" for a, x in V.ACRONYMS.items())


@query("query_expansion", QUESTIONS_SQL + f", e AS (SELECT conversation_id, turn, q, list_filter([{_ACRONYMS}], lambda x: x IS NOT NULL) AS more FROM questions) SELECT conversation_id, turn, trim(concat(q, ' ', array_to_string(more, ' '))) AS expanded, len(more) AS n FROM e WHERE len(more) > 0")
def query_expansion(spark, sf_dir):
    """Questions with acronyms, and what these stand for behind them."""
    more = P.acronyms(F.col("q"))
    return questions(spark, sf_dir).where(F.size(more) > 0).select("conversation_id", "turn", F.trim(F.concat_ws(" ", "q", F.array_join(more, " "))).alias("expanded"), F.size(more).cast("long").alias("n"))


_SYNONYMS = _ROWS([(i, a, s) for i, (a, ss) in enumerate(V.SYNONYMS.items()) for s in ss])


@query("query_variants", QUESTIONS_SQL + f", syn AS (SELECT * FROM (VALUES {_SYNONYMS}) AS s(ord, anchor, synonym)), v AS (SELECT conversation_id, turn, q, ord, synonym FROM questions, syn WHERE regexp_matches(q, concat('(?i)\\b', anchor, '\\b')) AND NOT regexp_matches(q, concat('(?i)\\b', synonym, '\\b'))) SELECT conversation_id, turn, concat(q, ' ', synonym) AS variant, CAST(row_number() OVER w + 1 AS INTEGER) AS place FROM v WINDOW w AS (PARTITION BY conversation_id, turn ORDER BY ord, synonym) QUALIFY row_number() OVER w <= 7")
def query_variants(spark, sf_dir):
    """Up to seven further wordings of a question by synonyms; place 1 is its own."""
    dim = F.broadcast(spark.createDataFrame([(i, a, s) for i, (a, ss) in enumerate(V.SYNONYMS.items()) for s in ss], "ord int, anchor string, synonym string"))
    q = questions(spark, sf_dir).withColumn("anchor", F.explode(P.anchors(F.col("q"))))
    has = F.expr("regexp_like(q, concat('(?i)\\\\b', synonym, '\\\\b'))")
    v = R.ranked(q.join(dim, "anchor").where(~has), ["conversation_id", "turn"], [F.col("ord"), F.col("synonym")], 7, "place")
    return v.select("conversation_id", "turn", F.concat_ws(" ", "q", "synonym").alias("variant"), (F.col("place") + 1).alias("place"))


@query("catalogue_overlap", QUESTIONS_SQL + ", c AS (SELECT DISTINCT source AS title FROM documents) SELECT conversation_id, turn, max(CASE WHEN contains(lower(q2), lower(title)) THEN 0.93::DOUBLE ELSE 0 END) AS score FROM (SELECT *, concat(q, ' SRC', conversation_id % 25) AS q2 FROM questions), c GROUP BY 1, 2 HAVING score > 0")
def catalogue_overlap(spark, sf_dir):
    """Questions that name a title of the catalogue."""
    from lodestack.operators.relational import first_contained

    q = questions(spark, sf_dir).withColumn("q", F.concat("q", F.lit(" SRC"), (F.col("conversation_id") % 25).cast("string")))
    found = first_contained(q, table(spark, sf_dir, "documents").select(F.col("source").alias("title")), ["conversation_id", "turn"], "q", "title")
    return found.select("conversation_id", "turn").distinct().withColumn("score", F.lit(0.93))


@query("contents_penalties", rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('1. Scope', chr(10), '2. Terms', chr(10), '3.1 Rules 4.1 Aims 5.2 Ends', chr(10), substr(text, 1, doc_id % 400)) ELSE text END AS text FROM documents), l AS (SELECT doc_id, trim(text) AS text, list_filter(list_transform(string_split(trim(text), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM t),
f AS (SELECT doc_id, text, len(lines) AS n, len(regexp_extract_all(text, '\b\d+\.\d*\s+[A-Z]')) AS packed, len(list_filter(lines, lambda x: regexp_matches(x, '^\d+(?:\.\d+)*\b'))) AS numbered, coalesce(list_sum(list_transform(list_filter(lines, lambda x: len(regexp_split_to_array(x, '\s+')) >= 12), lambda x: length(x))), 0) AS prose FROM l), g AS (SELECT *, CASE WHEN n > 0 THEN numbered / n ELSE 0 END AS ratio FROM f),
p AS (SELECT *, CASE WHEN packed >= 4 THEN 0.3::DOUBLE WHEN packed >= 2 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN ratio >= 0.55 THEN 0.3::DOUBLE WHEN ratio >= 0.35 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN length(text) < 280 AND packed + ratio * greatest(n, 1) >= 3 THEN 0.15::DOUBLE ELSE 0 END AS raw FROM g)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE round(least(1, CASE WHEN prose >= 180 THEN raw * 0.35::DOUBLE ELSE raw END), 6) END AS penalty FROM p""")
def contents_penalties(spark, sf_dir):
    """How much texts look like tables of contents."""
    listed = F.concat(F.lit("1. Scope\n2. Terms\n3.1 Rules 4.1 Aims 5.2 Ends\n"), F.col("text").substr(F.lit(1), (F.col("doc_id") % 400).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", A.contents_penalty(F.when(F.col("doc_id") % 3 == 0, listed).otherwise(F.col("text"))).alias("penalty"))


PAIRS_SQL = f"WITH {MESSAGES_SQL}, p AS (SELECT conversation_id, turn, content, lag(content) OVER (PARTITION BY conversation_id ORDER BY turn) AS evidence FROM messages), a AS (SELECT conversation_id, turn, content, evidence FROM p WHERE evidence IS NOT NULL AND turn % 2 = 1) "


def answers(spark, sf_dir):
    """conversation_id, turn, content, evidence: every second message with the one before it."""
    from pyspark.sql.window import Window

    before = F.lag("content").over(Window.partitionBy("conversation_id").orderBy("turn"))
    return messages(spark, sf_dir).withColumn("evidence", before).where("evidence IS NOT NULL AND turn % 2 = 1").select("conversation_id", "turn", "content", "evidence")


@query("claim_support", PAIRS_SQL + r", s AS (SELECT conversation_id, turn, evidence, unnest(range(len(l))) AS place, trim(unnest(l)) AS s FROM (SELECT *, regexp_split_to_array(regexp_replace(content, '([.!?])\s+', '\1' || chr(10), 'g'), '\n') AS l FROM a)), r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, turn ORDER BY length(s) DESC, place) AS r FROM s WHERE length(s) >= 25), w AS (SELECT *, list_distinct(regexp_extract_all(lower(s), '[a-z0-9]{3,}')) AS w, list_distinct(regexp_extract_all(lower(evidence), '[a-z0-9]{3,}')) AS k FROM r WHERE r <= 12), x AS (SELECT *, len(list_intersect(w, k)) / len(w) AS ratio FROM w WHERE len(w) >= 4) SELECT conversation_id, turn, CASE WHEN ratio >= 0.28 THEN 'supported' WHEN ratio >= 0.12 THEN 'partially_supported' ELSE 'unsupported' END AS support, count(*) AS n FROM x GROUP BY 1, 2, 3")
def claim_support(spark, sf_dir):
    """How many of the longest sentences of answers their evidence supports."""
    return A.claims(answers(spark, sf_dir), ["conversation_id", "turn"], "content", "evidence").groupBy("conversation_id", "turn", "support").agg(F.count("*").alias("n"))


@query("refusals", f"WITH {MESSAGES_SQL}, c AS (SELECT conversation_id, concat(content, CASE turn % 4 WHEN 0 THEN ' We could not find it.' WHEN 1 THEN ' According to plan.pdf and hr.pdf states so, per memo.pdf.' ELSE '' END) AS c FROM messages) SELECT count(*) FILTER (regexp_matches(c, '(?i){_Q(V.REFUSAL)}')) AS refusals, count(*) FILTER (len(regexp_extract_all(c, '(?i){V.ENUMERATION}')) >= 2) AS enumerations FROM c")
def refusals(spark, sf_dir):
    """Answers that refuse, and those that go through several documents."""
    k = F.col("turn") % 4
    c = F.concat("content", F.when(k == 0, " We could not find it.").when(k == 1, " According to plan.pdf and hr.pdf states so, per memo.pdf.").otherwise(""))
    return messages(spark, sf_dir).agg(F.count_if(c.rlike(f"(?i){V.REFUSAL}")).alias("refusals"), F.count_if(F.regexp_count(c, F.lit(f"(?i){V.ENUMERATION}")) >= 2).alias("enumerations"))


@query("unsupported_periods", f"WITH {MESSAGES_SQL}, p AS (SELECT conversation_id, turn, upper(regexp_replace(concat(content, CASE turn % 3 WHEN 0 THEN ' in q3  2027' WHEN 1 THEN ' for FY2031 and 2029' ELSE '' END), '\\s+', ' ', 'g')) AS asked, upper(regexp_replace(concat(content, CASE conversation_id % 2 WHEN 0 THEN ' q3 2027' ELSE ' fy2031' END), '\\s+', ' ', 'g')) AS known FROM messages), e AS (SELECT conversation_id, turn, known, unnest(list_distinct(regexp_extract_all(asked, '(?i){V.PERIOD}'))) AS period FROM p) SELECT conversation_id, turn, period FROM e WHERE NOT list_contains(regexp_extract_all(known, '(?i){V.PERIOD}'), period)")
def unsupported_periods(spark, sf_dir):
    """Periods that a question asks for and its evidence does not name."""
    k, c = F.col("turn") % 3, F.col("content")
    asked = F.concat(c, F.when(k == 0, " in q3  2027").when(k == 1, " for FY2031 and 2029").otherwise(""))
    known = F.concat(c, F.when(F.col("conversation_id") % 2 == 0, " q3 2027").otherwise(" fy2031"))
    m = messages(spark, sf_dir).select("conversation_id", "turn", X.periods(asked).alias("a"), X.periods(known).alias("k"))
    return m.select("conversation_id", "turn", F.explode(F.array_except("a", "k")).alias("period"))


_POS = lambda s: f"CASE WHEN instr(lower(c), '{s}') > 0 THEN instr(lower(c), '{s}') END"


@query("stage_order", f"WITH {MESSAGES_SQL}, m AS (SELECT conversation_id, turn, concat(content, [' creation then review and approval', ' approval before review', ' archive', ' retention, metadata, archive'][1 + turn % 4]) AS c FROM messages), s AS (SELECT conversation_id, turn, list_filter([{', '.join(_POS(s) for s in V.STAGES)}], lambda x: x IS NOT NULL) AS pos FROM m) SELECT conversation_id, turn, len(pos) < 2 OR pos = list_sort(pos) AS in_order FROM s")
def stage_order(spark, sf_dir):
    """Whether the stages that an answer names stand in their order."""
    tail = F.get(F.array(*[F.lit(x) for x in (" creation then review and approval", " approval before review", " archive", " retention, metadata, archive")]), (F.col("turn") % 4).cast("int"))
    c = F.lower(F.concat("content", tail))
    at = F.array_compact(F.array(*[F.when(F.locate(s, c) > 0, F.locate(s, c)) for s in V.STAGES]))
    return messages(spark, sf_dir).select("conversation_id", "turn", ((F.size(at) < 2) | (at == F.array_sort(at))).alias("in_order"))


@query("citation_check", f"WITH {DOCS_SQL}, x AS (SELECT doc_id AS case_id, collection AS source, CAST(doc_id % 5 AS INTEGER) AS page FROM docs UNION ALL SELECT doc_id, 'src1', NULL FROM docs WHERE doc_id % 6 = 0), c AS (SELECT doc_id AS case_id, collection AS source, CAST(doc_id % 4 AS INTEGER) AS page FROM docs UNION ALL SELECT doc_id, 'src1', 1 FROM docs WHERE doc_id % 4 = 0), m AS (SELECT x.case_id, x.source, x.page, count(c.source) FILTER (x.page IS NULL OR c.page = x.page) AS n FROM x LEFT JOIN c USING (case_id, source) GROUP BY ALL) SELECT case_id, count(*) FILTER (n = 0) = 0 AS passed FROM m GROUP BY 1")
def citation_check(spark, sf_dir):
    """Whether all expected sources, with their page where one is given, are cited in a case."""
    d, k = documents(spark, sf_dir), F.col("doc_id")
    page = lambda x: x.cast("int").alias("page")
    part = lambda where, source, p: d.where(where).select(k.alias("case_id"), source.alias("source"), page(p))
    expected = part("true", F.col("collection"), k % 5).unionByName(part("doc_id % 6 = 0", F.lit("src1"), F.lit(None)))
    cited = part("true", F.col("collection"), k % 4).unionByName(part("doc_id % 4 = 0", F.lit("src1"), F.lit(1)))
    lost = expected.alias("x").join(cited.alias("c"), (F.col("x.case_id") == F.col("c.case_id")) & (F.col("x.source") == F.col("c.source")) & (F.col("x.page").isNull() | (F.col("c.page") == F.col("x.page"))), "left_anti")
    failed = lost.select("case_id").distinct().withColumn("failed", F.lit(True))
    return expected.select("case_id").distinct().join(failed, "case_id", "left").select("case_id", F.col("failed").isNull().alias("passed"))


@query("model_recommendation", f"WITH {DOCS_SQL}, m AS (SELECT collection AS model, avg(CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS r5, avg(CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS r1, avg(1.0::DOUBLE / (1 + doc_id % 4)) AS mrr, avg(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0 END) AS answers, avg((doc_id % 5) / 5.0::DOUBLE) AS context, avg(CASE WHEN visibility = 'public' THEN 1.0::DOUBLE ELSE 0 END) AS citations, avg(file_size % 200) AS ms FROM docs GROUP BY 1) SELECT model, round(r5 * 0.3::DOUBLE + r1 * 0.15::DOUBLE + mrr * 0.2::DOUBLE + answers * 0.15::DOUBLE + context * 0.1::DOUBLE + citations * 0.1::DOUBLE - ms / 100 * 0.02::DOUBLE, 6) AS score FROM m ORDER BY score DESC, model LIMIT 1")
def model_recommendation(spark, sf_dir):
    """The model with the best weighted figures."""
    k, yes = F.col("doc_id"), lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    m = documents(spark, sf_dir).groupBy(F.col("collection").alias("model")).agg(yes(k % 2 == 0).alias("r5"), yes(k % 3 == 0).alias("r1"), F.avg(1.0 / (1 + k % 4)).alias("mrr"), yes(F.col("lang") == "en").alias("answers"), F.avg((k % 5) / 5.0).alias("context"), yes(F.col("visibility") == "public").alias("citations"), F.avg(F.col("file_size") % 200).alias("ms"))
    score = F.col("r5") * 0.30 + F.col("r1") * 0.15 + F.col("mrr") * 0.20 + F.col("answers") * 0.15 + F.col("context") * 0.10 + F.col("citations") * 0.10 - F.col("ms") / 100 * 0.02
    return m.select("model", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "model").limit(1)


_OVERLAP = lambda a, b: f"len(list_intersect({a}, {b})) / greatest(1, len(list_distinct(list_concat({a}, {b}))))"
_LONG = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 2))"
BONUS_SQL = S.BM25_SQL + f""", hit AS (SELECT s.query, s.doc, s.score, s.rank, b.text AS q, d.text, concat(d.source, ' ', array_to_string((regexp_extract_all(lower(d.text), '[a-z]{{3,}}'))[1:6], ' ')) AS title, d.source, CASE s.doc % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'list' WHEN 2 THEN 'paragraph' ELSE 'section_header' END AS kind FROM sparse s JOIN benchmark b ON item_id = query JOIN documents d ON doc_id = doc WHERE rank <= 20),
o AS (SELECT *, {_OVERLAP(_LONG('q'), _LONG('title'))} AS heading, {P.rules_sql('trim(q)', V.INTENTS, 'general')} AS intent, count(*) OVER (PARTITION BY query, source) > 1 AS same_source, count(*) OVER (PARTITION BY query, doc - 1) > 0 AS x FROM hit),
n AS (SELECT o.*, EXISTS (SELECT 1 FROM hit h WHERE h.query = o.query AND abs(h.doc - o.doc) = 1) AS adjacent FROM o),
r AS (SELECT *, (0.04::DOUBLE + 0.05::DOUBLE + 0.03::DOUBLE) * heading + CASE WHEN kind = 'section_header' THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN intent = 'list_intent' AND kind = 'list' THEN 0.05::DOUBLE WHEN intent = 'table_intent' AND kind = 'table' THEN 0.05::DOUBLE WHEN intent = 'section_lookup' AND kind = 'section_header' THEN 0.04::DOUBLE WHEN intent = 'entity_lookup' AND kind = 'paragraph' THEN 0.04::DOUBLE WHEN intent = 'numeric_intent' AND kind = 'table' THEN 0.03::DOUBLE WHEN intent = 'general' AND kind = 'paragraph' THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN same_source THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN adjacent THEN 0.02::DOUBLE ELSE 0 END AS raw FROM n),
b AS (SELECT query, doc, round(0.15::DOUBLE * tanh(raw / 0.15::DOUBLE), 4) AS bonus, round(least(1, least(greatest((least(0.75::DOUBLE, score / 10) - 0.15::DOUBLE) / 0.75::DOUBLE, 0), 1) + 0.15::DOUBLE * tanh(raw / 0.15::DOUBLE)), 4) AS final, score FROM r) """


@query("metadata_bonus", BONUS_SQL + "SELECT query, doc, bonus, final, CAST(row_number() OVER (PARTITION BY query ORDER BY final DESC, score DESC, doc) AS INTEGER) AS place FROM b")
def metadata_bonus(spark, sf_dir):
    """Keyword results rescored by what their titles, kinds and neighbours add, under a soft ceiling."""
    hits = S.sparse(spark, sf_dir, 20)
    d, k = table(spark, sf_dir, "documents"), F.col("doc") % 4
    title = F.concat("source", F.lit(" "), F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0), 1, 6), " "))
    own = hits.join(d.select(F.col("doc_id").alias("doc"), title.alias("title"), "source"), "doc").join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("q")), "query")
    kind = F.when(k == 0, "table").when(k == 1, "list").when(k == 2, "paragraph").otherwise("section_header")
    scored = P.with_bonus(own.withColumns({"kind": kind, "path": F.col("title"), "order": F.col("doc")}))
    final = F.round(F.least(F.lit(1.0), X.unit((F.least(F.lit(0.75), F.col("score") / 10) - 0.15) / 0.75) + F.col("bonus")), 4)
    out = scored.select("query", "doc", F.round("bonus", 4).alias("bonus"), final.alias("final"), "score")
    return R.ranked(out, ["query"], [F.desc("final"), F.desc("score"), F.col("doc")], 20, "place").drop("score")


@query("self_retrieval", f"""WITH d AS (SELECT doc_id AS doc, {X.tokens_sql('text')} AS w FROM documents), probe AS (SELECT doc AS query, list_distinct(w[1:8]) AS p FROM d WHERE doc % 50 = 0 AND len(w) > 0), t AS (SELECT DISTINCT doc, unnest(w) AS term FROM d), h AS (SELECT query, doc, count(*) AS n FROM (SELECT query, unnest(p) AS term FROM probe) JOIN t USING (term) GROUP BY 1, 2)
SELECT p.query, coalesce(max(n) FILTER (doc = p.query), 0) = len(any_value(p.p)) AS found, count(*) FILTER (n = len(p.p)) AS n_equal FROM probe p LEFT JOIN h ON h.query = p.query GROUP BY 1""")
def self_retrieval(spark, sf_dir):
    """Whether the first eight words of a document find it in the index, for every fiftieth, and how many documents have them all."""
    probe = S.corpus(spark, sf_dir).where((F.col("doc_id") % 50 == 0) & (F.size("words") > 0)).select("doc_id", F.slice("words", 1, 8).alias("p"))
    return B.holders(S.blocks(spark, sf_dir), probe, "doc_id", "p").withColumnRenamed("n", "n_equal")
