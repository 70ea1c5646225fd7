"""What a question asks for: category, intent, safety, follow-ups; and how evidence for it is weighed and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.fixed import (
    ACRONYMS,
    ADJACENT,
    CATEGORIES,
    HEADER_BOOST,
    HEADING_WEIGHT,
    INTENT_INDEXES,
    INTENTS,
    LATEST,
    LEGITIMATE,
    LIST_BOOST,
    MOST_BONUS,
    NUMERIC_BOOST,
    OLDEST,
    PARAGRAPH_BOOST,
    PATH_WEIGHT,
    PLAN_INTENTS,
    SAME_SOURCE,
    SYNONYMS,
    TABLE_BOOST,
    TITLE_WEIGHT,
    TYPE_WEIGHT,
    UNSAFE,
)
from lodestack.functions.text import jaccard, soft_ceiling
from lodestack.operators.knowledge import first_match

FOLLOW_UP = r"^\s*(and|also|what about|how about|why|it|that|those|they|more)\b"
#: Fixed sizes of the context by category.
CONTEXT = {"list": 8, "table": 8, "definition": 12}


def any_of(patterns: tuple[str, ...]) -> str:
    """One pattern for several, without regard to case."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def rules_sql(column: str, rules, default: str) -> str:
    """SQL for the label of the first rule (label, patterns) that matches. Word borders there know ASCII only, so accented letters are made plain ones."""
    column = f"regexp_replace({column}, '[À-ÖØ-öø-žß]', 'x', 'g')"
    quoted = lambda patterns: any_of(patterns).replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{quoted(p)}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


def category(question: Column) -> Column:
    """The first category of which a pattern matches; general for all others and for empty questions."""
    return first_match(F.trim(question), tuple((n, any_of(p)) for n, p in CATEGORIES), "general")


def intent(question: Column) -> Column:
    """What the question looks for in the structure of documents."""
    return first_match(F.trim(question), tuple((n, any_of(p)) for n, p in INTENTS), "general")


def first_of(text: Column, rules, default: str) -> Column:
    """The label of the first rule (label, patterns) of which a pattern matches."""
    return first_match(text, tuple((n, any_of(p)) for n, p in rules), default)


def plan_intents(question: Column, most: int = 5) -> Column:
    """(intent, confidence) of the intents that a question shows, the surest first; each hit beyond the first adds 0.03, up to 0.99."""
    found = []
    for i, (name, base, patterns) in enumerate(PLAN_INTENTS):
        n = sum((question.rlike(f"(?i){p}").cast("int") for p in patterns), F.lit(0))
        found.append(F.when(n > 0, F.struct((-F.round(F.least(F.lit(0.99), base + 0.03 * (n - 1)), 3)).alias("less"), F.lit(i).alias("order"), F.lit(name).alias("intent"))))
    return F.transform(F.slice(F.array_sort(F.array_compact(F.array(*found))), 1, most), lambda x: F.struct(x["intent"].alias("intent"), (-x["less"]).alias("confidence")))


def required_indexes(question: Column) -> Column:
    """The indexes that a plan for a question needs, by its first intent; the newest or oldest need versions besides."""
    table = F.create_map(*[x for k, v in INTENT_INDEXES.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    first = F.coalesce(F.get(plan_intents(question, 1), 0)["intent"], F.lit("unknown"))
    dated = F.lower(question).rlike(LATEST) | F.lower(question).rlike(OLDEST)
    more = F.when(dated, F.array(F.lit("version"), F.lit("metadata"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.element_at(table, first), more))


def acronyms(question: Column) -> Column:
    """What the acronyms in a question stand for, where it does not say so itself."""
    return F.array_compact(F.array(*[F.when(question.rlike(rf"(?i)\b{a}\b") & ~F.contains(F.lower(question), F.lit(x)), x) for a, x in ACRONYMS.items()]))


def anchors(question: Column) -> Column:
    """The words of a question for which there are synonyms."""
    return F.array_compact(F.array(*[F.when(question.rlike(rf"(?i)\b{a}\b"), a) for a in SYNONYMS]))


def with_bonus(hits: DataFrame) -> DataFrame:
    """hits (query, q, doc, title, path, kind, source, order) with bonus: likeness of the question to title and path, a kind that suits its intent, and
    neighbours among the results of the same query; under a soft ceiling."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) > 2))
    like = lambda c: jaccard(words(F.col("q")), words(F.col(c)))
    asks, kind = intent(F.col("q")), F.col("kind")
    suits = (
        F.when((asks == "list_intent") & (kind == "list"), LIST_BOOST).when((asks == "table_intent") & (kind == "table"), TABLE_BOOST).when((asks == "section_lookup") & kind.isin("section_header", "subsection"), HEADER_BOOST)
        .when((asks == "entity_lookup") & (kind == "paragraph"), PARAGRAPH_BOOST).when((asks == "numeric_intent") & (kind == "table"), NUMERIC_BOOST).when((asks == "general") & (kind == "paragraph"), PARAGRAPH_BOOST * 0.5).otherwise(0.0)
    )
    peers = F.count("*").over(Window.partitionBy("query", "source")) > 1  # the results of a query are few
    w = Window.partitionBy("query").orderBy("order").rangeBetween(-1, 1)
    next_to = F.count(F.lit(1)).over(w) > F.count(F.lit(1)).over(Window.partitionBy("query").orderBy("order").rangeBetween(0, 0))
    raw = HEADING_WEIGHT * like("title") + TITLE_WEIGHT * like("title") + PATH_WEIGHT * like("path") + F.when(kind == "section_header", TYPE_WEIGHT * 0.5).otherwise(0.0) + suits
    raw = raw + F.when(peers, SAME_SOURCE).otherwise(0.0) + F.when(next_to, ADJACENT).otherwise(0.0)
    return hits.withColumn("bonus", soft_ceiling(raw, MOST_BONUS))


def context_size(of: Column) -> Column:
    out = F.lit(5)
    for name, n in CONTEXT.items():
        out = F.when(of == name, n).otherwise(out)
    return out


def safety(question: Column) -> Column:
    """A question in a legitimate frame is safe whatever else it says."""
    return F.when(question.rlike(any_of((LEGITIMATE,))), "safe").when(question.rlike(any_of(UNSAFE)), "unsafe").otherwise("safe")


def route(question: Column, before: Column, documents: Column) -> Column:
    """unsafe, then the category's domain; a follow-up goes where the question before it went; without documents all is general."""
    own = F.when(category(question).isin("security", "financial", "policy", "procedure", "table", "numeric"), "document").otherwise("general")
    return F.when(safety(question) == "unsafe", "unsafe").when(documents == 0, "general").when(question.rlike(any_of((FOLLOW_UP,))) & before.isNotNull(), before).otherwise(own)


def tiers(scored: DataFrame, query: str, score: str, doc: str) -> DataFrame:
    """scored with tier: primary from max(0.45, best - 0.22), supporting from max(0.25, best - 0.45), else optional; the best (of equal ones
    the smallest doc) is always primary. A query may have any number of rows."""
    best = scored.groupBy(query).agg(F.max(score).alias("_top"), F.min_by(doc, F.struct(-F.col(score), F.col(doc))).alias("_first"))
    top = F.col("_top")
    tier = F.when((F.col(score) >= F.greatest(F.lit(0.45), top - 0.22)) | (F.col(doc) == F.col("_first")), "primary").when(F.col(score) >= F.greatest(F.lit(0.25), top - 0.45), "supporting").otherwise("optional")
    return scored.join(best, query).withColumn("tier", tier).drop("_top", "_first")


def merged_variants(hits: DataFrame, query: str, doc: str, limit: int, damp: int = 60) -> DataFrame:
    """(query, doc, position): hits (query, variant, doc, rank) of several wordings of a query, variant 0 being its own.

    The first half of the places goes to the own wording in its order, the rest to the largest sums of reciprocal ranks over all.
    """
    held = max(limit // 2, 1)
    fused = hits.groupBy(query, doc).agg(F.sum(1 / (F.lit(damp) + F.col("rank"))).alias("fused"), F.min(F.when(F.col("variant") == 0, F.col("rank"))).alias("own"))
    own = F.row_number().over(Window.partitionBy(query).orderBy(F.coalesce("own", F.lit(2**31 - 1)), doc))
    kept = fused.withColumn("reserved", F.when(F.col("own").isNotNull() & (own <= held), own))
    order = [F.coalesce("reserved", F.lit(2**31 - 1)), F.desc(F.round("fused", 9)), F.col(doc)]
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("position") <= limit).select(query, doc, "position")


def blended(rerank: Column, hybrid: Column, metadata: Column, contents: Column, stub: Column, masthead: Column) -> Column:
    """The final score of a result: 0.55, 0.20 and 0.25 of the normalised parts, less penalties."""
    return F.round(F.round(0.55 * rerank + 0.20 * hybrid + 0.25 * metadata - 0.18 * contents - 0.55 * stub - 0.45 * masthead, 9), 4)


def stub(text: Column) -> Column:
    """Whether a text says hardly anything: empty, or up to 48 characters and six words."""
    short = F.trim(F.regexp_replace(text, r"\s+", " "))
    return (short == "") | ((F.length(short) <= 48) & (F.size(F.split(short, " ")) <= 6))
