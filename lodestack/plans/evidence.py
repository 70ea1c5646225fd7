"""Evidence for questions: how well it fits, and how sure answers from it are."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions import fixed as V
from lodestack.functions import text as X
from lodestack.functions.bindings import messages
from lodestack.operators import evidence as E
from lodestack.operators import knowledge as K
from lodestack.operators import passages as A
from lodestack.operators import planning as P
from lodestack.plans import retrieval as S
from lodestack.plans.registry import query
from lodestack.session import table

_TYPES, _KINDS = [(n, (p,)) for n, p in V.ANSWERS], [(n, (p,)) for n, p in V.STRUCTURES]
_SEVERAL = lambda cs: "(" + " OR ".join(cs) + ")"
_WORDS = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}'))"
_SHARED = lambda x: f"len(list_intersect({_WORDS(x)}, {_WORDS('q')}))"
_HITS = "CASE " + " ".join(f"WHEN answer_type = '{n}' THEN " + " + ".join(f"contains(hay, '{k}')::INT" for k in keys) for n, keys in V.PRIMARY_WORDS.items()) + " ELSE 0 END"
_SUITS = _SEVERAL(f"(answer_type = '{n}' AND kind IN ({', '.join(repr(k) for k in kinds)}))" for n, kinds in V.SUITED_KINDS.items())
_ASIDE = _SEVERAL(f"(regexp_extract(plain, '{p}') <> '' AND NOT contains(q, regexp_extract(plain, '{p}')) AND len(list_filter(string_split(regexp_extract(plain, '{p}'), ' '), lambda y: contains(q, y))) = 0)" for p in V.ASIDES)
_SUPPORTS = _SEVERAL(f"regexp_matches(plain, '{p}')" for p in V.SUPPORTING)
SCORES_SQL = S.BM25_SQL + f""", e AS (SELECT query, doc, lower(b.text) AS q, array_to_string(d.w[1:6], ' ') AS label, lower(o.text) AS body, lower(o.source) AS source, {P.rules_sql('lower(trim(b.text))', _TYPES, 'explanation').replace("what'?s", "what''?s")} AS answer_type, {P.rules_sql('o.text', _KINDS, 'general')} AS kind
  FROM sparse JOIN benchmark b ON item_id = query JOIN documents o ON o.doc_id = doc JOIN d USING (doc) WHERE rank <= 10),
h AS (SELECT *, concat_ws(' ', label, body, source) AS hay, regexp_replace(concat_ws(' ', label, body, source), '[À-ÖØ-öø-žß]', 'x', 'g') AS plain FROM e), n AS (SELECT *, {_HITS} AS hits, {_ASIDE} AS beside FROM h),
scores AS (SELECT query, doc, answer_type, kind, round(greatest(0, least(1.25, 0.15::DOUBLE + least(0.35::DOUBLE, 0.12::DOUBLE * {_SHARED('label')}) + least(0.12::DOUBLE, 0.03::DOUBLE * {_SHARED('body')}) + least(0.40::DOUBLE, 0.14::DOUBLE * hits) + CASE WHEN {_SUITS} THEN 0.18::DOUBLE ELSE 0 END
  + CASE WHEN {_SUPPORTS} AND hits = 0 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN length(body) >= 180 THEN 0.10::DOUBLE WHEN length(body) < 40 THEN -0.12::DOUBLE ELSE 0 END + CASE WHEN {_SHARED('source')} > 0 THEN 0.06::DOUBLE ELSE 0 END
  - CASE WHEN beside THEN 0.28::DOUBLE ELSE 0 END - CASE WHEN kind = 'appendix' THEN 0.20::DOUBLE WHEN kind = 'examples' AND hits = 0 THEN 0.05::DOUBLE ELSE 0 END)), 4) AS score, hits > 0 AS "primary", beside OR kind = 'appendix' AS aside FROM n) """


@query("evidence_scores", SCORES_SQL + 'SELECT query, doc, answer_type, kind, score, "primary", aside, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS place FROM scores')
def evidence_scores(spark, sf_dir):
    """The ten best documents of each item by keywords, in the order of how well they fit it as evidence."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("q"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", "source")
    e = S.sparse(spark, sf_dir, 10).select("query", "doc").join(items, "query").join(docs, "doc")
    e = e.withColumns({"answer_type": P.first_of(F.lower(F.trim("q")), _TYPES, "explanation"), "kind": P.first_of(F.col("text"), _KINDS, "general"), "label": F.array_join(F.slice(X.tokens(F.col("text")), 1, 6), " ")})
    scored = e.withColumn("s", E.evidence_score(*(F.col(c) for c in ("q", "label", "text", "source", "kind", "answer_type"))))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s.score"), "doc"))
    return scored.select("query", "doc", "answer_type", "kind", "s.score", "s.primary", "s.aside", place.alias("place"))


@query("answer_confidence")
def answer_confidence(spark, sf_dir):
    """How sure every second message is as an answer to the one before it, with the one before that as evidence; some refuse, and some ask for a concept."""
    w = Window.partitionBy("conversation_id").orderBy("turn")
    concept = F.get(F.array(*[F.lit(x) for x in ("", " about the vpn budget", " about annual leave", "")]), (F.col("conversation_id") % 4).cast("int"))
    m = messages(spark, sf_dir).withColumns({"question": F.concat(F.lag("content").over(w), concept), "evidence": F.concat(F.lag("content", 2).over(w), F.when(F.col("turn") % 4 == 1, " the vpn is for annual leave").otherwise(""))})
    m = m.where("turn % 2 = 1 AND question IS NOT NULL").withColumn("answer", F.concat("content", F.when(F.col("turn") % 3 == 0, " the vpn does").otherwise(""), F.when((F.col("conversation_id") + F.col("turn")) % 7 == 0, " We could not find it.").otherwise("")))
    return judged_answers(m, ["conversation_id", "turn"])


def judged_answers(m, key):
    """(key, completeness, intent, confidence, label, reliability) of rows with question, evidence and answer."""
    concepts = lambda c: K.concepts(F.lower(F.coalesce(c, F.lit(""))))
    terms = F.filter(E.words_of(F.col("question")), lambda t: (F.length(t) >= 4))
    m = m.select(*key, "question", "evidence", "answer").withColumns({"terms": terms, "asked": concepts("question"), "known": concepts("evidence"), "named": concepts("answer")})
    support = A.claims(m.where("evidence IS NOT NULL"), key, "answer", "evidence").groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("support") == "supported").alias("good"), F.count_if(F.col("support") == "partially_supported").alias("some"))
    m = m.join(support, key, "left").withColumns({"c": E.coverage(*(F.col(x) for x in ("terms", "evidence", "answer", "asked", "known"))), "answered": F.array_intersect("asked", "named")})
    share = lambda x, of: F.when(F.size(of) > 0, F.size(x) / F.size(of)).otherwise(0.75)
    answer = F.lower(F.coalesce("answer", F.lit("")))
    at = F.array_compact(F.array(*[F.when(F.locate(s, answer) > 0, F.locate(s, answer)) for s in V.STAGES]))
    kind = E.completeness(F.col("answer"), F.col("evidence").isNotNull(), F.col("c.covered"), F.col("asked"), F.col("answered"))
    grounding = F.coalesce((F.col("good") + 0.5 * F.col("some")) / F.col("n"), F.lit(0.5))
    unsupported = F.coalesce((F.col("n") - F.col("good") - F.col("some")) / F.col("n"), F.lit(0.0))
    sure = E.confidence(
        F.col("kind"), share("answered", "asked"), share(F.array_intersect("answered", "known"), "asked"), grounding, unsupported, F.col("c.intent"), F.col("c.specificity"), F.col("c.match"),
        (F.size(at) < 2) | (at == F.array_sort(at)), F.lit(0), F.coalesce((F.col("good") + F.col("some")) / F.col("n"), F.lit(0.5)), F.lit(1.0),
    )
    return m.withColumn("kind", kind).withColumn("s", sure).select(*key, F.col("kind").alias("completeness"), "c.intent", "s.confidence", "s.label", "s.reliability")
