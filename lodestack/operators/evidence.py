"""How well evidence fits a question, how far it covers what is asked, and how sure an answer is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.fixed import ASIDES, PRIMARY_WORDS, REFUSAL, SUITED_KINDS, SUPPORTING


def words_of(x: Column) -> Column:
    """The distinct runs of at least three ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]{3,}"), 0))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _aside(hay: Column, question: Column, pattern: str) -> Column:
    found = F.regexp_extract(hay, pattern, 0)
    return (found != "") & ~F.contains(question, found) & ~F.exists(F.split(found, r"\s+"), lambda p: F.contains(question, p))


def evidence_score(question: Column, label: Column, body: Column, source: Column, kind: Column, answer_type: Column) -> Column:
    """(score, primary, aside): from 0 to 1.25, how well a piece of evidence fits a question of a type of answer.

    Shared words with its label weigh most, then words that show the type, the kind of structure, length, shared words with its body and source; what is beside the point,
    appendices and stubs lose. Nulls count as empty.
    """
    q, label, body, source = (F.lower(F.coalesce(x, F.lit(""))) for x in (question, label, body, source))
    hay = F.concat_ws(" ", label, body, source)
    shared = lambda x: F.size(F.array_intersect(words_of(x), words_of(q)))
    hits = F.lit(0)
    for name, keys in PRIMARY_WORDS.items():
        hits = F.when(answer_type == name, sum((F.contains(hay, F.lit(k)).cast("int") for k in keys), F.lit(0))).otherwise(hits)
    suits = F.coalesce(_any((answer_type == name) & kind.isin(*kinds) for name, kinds in SUITED_KINDS.items()), F.lit(False))
    supports, aside = _any(hay.rlike(p) for p in SUPPORTING), _any(_aside(hay, q, p) for p in ASIDES)
    n, if_so = F.length(body), lambda c, x: F.when(c, x).otherwise(0.0)
    total = 0.15 + F.least(F.lit(0.35), 0.12 * shared(label)) + F.least(F.lit(0.12), 0.03 * shared(body)) + F.least(F.lit(0.40), 0.14 * hits) + if_so(suits, 0.18)
    total = total + if_so(supports & (hits == 0), 0.08) + F.when(n >= 180, 0.10).when(n < 40, -0.12).otherwise(0.0) + if_so(shared(F.regexp_replace(source, r"_|\.pdf", " ")) > 0, 0.06)
    total = total - if_so(aside, 0.28) - F.when(kind == "appendix", 0.20).when((kind == "examples") & (hits == 0), 0.05).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.25), total)), 4)
    return F.struct(score.alias("score"), (hits > 0).alias("primary"), (aside | F.coalesce(kind == "appendix", F.lit(False))).alias("aside"))


def soft_hits(terms: Column, text: Column) -> Column:
    """How many terms stand in a text in lower case, or begin, from four letters on, with the same letters as one of its words (as many as a shorter word has, at most four)."""
    text = F.coalesce(text, F.lit(""))
    heads = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\S+"), 0), lambda w: F.substring(w, 1, 4)))
    return F.size(F.filter(terms, lambda t: F.contains(text, t) | ((F.length(t) >= 4) & F.exists(heads, lambda h: F.substring(t, 1, 4).startswith(h)))))


def coverage(terms: Column, evidence: Column, answer: Column, asked: Column, known: Column, top: int = 500) -> Column:
    """(intent, specificity, match, covered): how far evidence covers the terms and concepts of a question.

    terms: of the question; asked and known: the concepts of the question and of the evidence. Specificity is by the beginning of the evidence, match by the answer. A question without terms counts half.
    """
    n = F.size(terms)
    share = lambda x: F.when(n > 0, soft_hits(terms, F.lower(x)) / n).otherwise(0.5)
    held, specificity, match = share(evidence), share(F.substring(F.coalesce(evidence, F.lit("")), 1, top)), share(answer)
    concept = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, known)) / F.size(asked))
    blended = F.when(concept.isNotNull(), 0.50 * concept + 0.30 * held + 0.20 * specificity).otherwise(0.65 * held + 0.35 * specificity)
    intent = F.when(concept >= 0.99, F.greatest(blended, F.lit(0.70))).otherwise(blended)
    return F.struct(F.round(intent, 4).alias("intent"), F.round(specificity, 4).alias("specificity"), F.round(match, 4).alias("match"), F.coalesce((concept >= 0.99) | (blended >= 0.40), F.lit(False)).alias("covered"))


def completeness(answer: Column, has_evidence: Column, covered: Column, asked: Column, answered: Column) -> Column:
    """What kind of answer it is. asked and answered: concepts of the question, and those of them that the answer names."""
    some, missing = F.size(answered) > 0, F.size(F.array_except(asked, answered)) > 0
    return F.when(~has_evidence, "no_evidence").when(F.coalesce(answer, F.lit("")).rlike(f"(?i){REFUSAL}"), "explicit_refusal").when(~covered, "related_not_answering").when(missing & some, "partial").when(missing, "related_not_answering").otherwise("complete")


def confidence(kind: Column, question_coverage: Column, concept_coverage: Column, grounding: Column, unsupported: Column, intent: Column, specificity: Column, match: Column, in_order: Column, redundant: Column, density: Column, blueprint: Column) -> Column:
    """(confidence, label, reliability) of an answer of a kind of completeness. All shares are from 0 to 1; redundant is how many concepts it names again."""
    one = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    base = 0.18 * question_coverage + 0.12 * concept_coverage + 0.18 * grounding + 0.10 * blueprint + 0.08 * density + 0.08 * (1.0 - unsupported)
    base = base + 0.06 * F.when(in_order, 1.0).otherwise(0.40) + 0.12 * intent + 0.05 * specificity + 0.03 * match
    base = one(base - F.least(F.lit(0.25), 0.05 * redundant) - F.when(in_order, 0.0).otherwise(0.14))
    partial = one(one(0.58 + 0.22 * base - 0.10 * (1.0 - intent)) - 0.04)
    partial = F.when(partial > 0.78, 0.70 + 0.08 * grounding).when(partial < 0.45, 0.45 + 0.10 * grounding).otherwise(partial)
    strong = (question_coverage >= 0.85) & (grounding >= 0.80) & (intent >= 0.70) & (unsupported <= 0.05) & (specificity >= 0.40) & in_order
    whole = F.when(strong, F.least(F.lit(0.98), F.greatest(base, F.lit(0.92)) + 0.03)).when((intent < 0.55) | (specificity < 0.30), F.least(base, F.lit(0.55))).otherwise(base)
    whole = F.when(in_order, whole).otherwise(F.least(whole, F.lit(0.78)))
    refusal = F.when(intent < 0.35, 0.12).otherwise(0.15)
    overall = F.when(kind == "no_evidence", 0.03).when(kind == "explicit_refusal", F.when(intent >= 0.45, 0.20).otherwise(refusal)).when(kind == "related_not_answering", refusal).when(kind == "partial", partial).otherwise(whole)
    sure = F.round(one(overall), 6)
    label = F.when(sure >= 0.80, "high").when(sure >= 0.55, "medium").otherwise("low")
    reliable = F.when(kind == "no_evidence", 0.05).when(kind.isin("explicit_refusal", "related_not_answering"), one(0.10 + 0.20 * intent)).when(kind == "partial", one(0.55 * sure + 0.25 * intent + 0.20 * specificity)).otherwise(one(0.50 * sure + 0.30 * intent + 0.20 * match))
    return F.struct(sure.alias("confidence"), label.alias("label"), F.round(reliable, 4).alias("reliability"))
