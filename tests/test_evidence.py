"""Evidence scores, coverage and confidence, against plain versions of the rules."""

import random
import re

from pyspark.sql import functions as F

from lodestack.functions import fixed as V
from lodestack.operators import evidence as E
from lodestack.plans import evidence as P

PHRASES = ["the policy", "must require scope", "for example", "history of it", "appendix b", "approval committee", "see also", "vpn", "owner", "x", "retention of drafts", "step by step words", "long " * 50, "errors", "background"]


def score(q, label, body, source, kind, answer_type):
    q, label, body, source = ((x or "").lower() for x in (q, label, body, source))
    tokens = lambda x: set(re.findall("[a-z0-9]{3,}", x))
    hay, asked, out = f"{label} {body} {source}", tokens(q), 0.15
    out += min(0.35, 0.12 * len(tokens(label) & asked)) + min(0.12, 0.03 * len(tokens(body) & asked))
    hits = sum(k in hay for k in V.PRIMARY_WORDS.get(answer_type, ()))
    out += min(0.40, 0.14 * hits) + 0.18 * (kind in V.SUITED_KINDS.get(answer_type, ()))
    if not hits and any(re.search(p, hay) for p in V.SUPPORTING):
        out += 0.08
    out += 0.10 if len(body) >= 180 else -0.12 if len(body) < 40 else 0
    out += 0.06 * bool(tokens(source.replace("_", " ").replace(".pdf", " ")) & asked)
    aside = False
    for p in V.ASIDES:
        m = re.search(p, hay)
        if m and m[0] not in q and not any(x in q for x in m[0].split()):
            aside = True
    out -= 0.28 * aside
    out -= 0.20 if kind == "appendix" else 0.05 if kind == "examples" and not hits else 0
    return max(0, min(1.25, out)), hits > 0, aside or kind == "appendix"


def test_scores_are_the_plain_ones(spark):
    rng = random.Random(4)
    some = lambda n: rng.choice([None, "", *(" ".join(rng.choices(PHRASES, k=rng.randrange(1, n))) for _ in range(9))])
    rows = [(i, some(4), some(3), some(7), rng.choice(["Retention_policy.pdf", "history", None]), rng.choice(["appendix", "examples", "policy", "list", "committee", "general"]), rng.choice([*V.PRIMARY_WORDS, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, q string, label string, body string, source string, kind string, answer_type string")
    got = {r.i: (r.s.score, r.s.primary, r.s.aside) for r in df.select("i", E.evidence_score(*(F.col(c) for c in df.columns[1:])).alias("s")).collect()}
    for i, *row in rows:
        want = score(*row)
        assert abs(got[i][0] - want[0]) < 1e-4 and got[i][1:] == want[1:], row
    assert len({s for s, *_ in got.values()}) > 30


def covered(terms, evidence, answer, asked, known):
    def hit(t, x):
        return t in x or (len(t) >= 4 and any(w.startswith(t[:4]) or t[:4].startswith(w[:4]) for w in x.split()))

    share = lambda x: sum(hit(t, (x or "").lower()) for t in terms) / len(terms) if terms else 0.5
    held, top, match = share(evidence), share((evidence or "")[:500]), share(answer)
    concept = len(set(asked) & set(known)) / len(asked) if asked else None
    intent = 0.5 * concept + 0.3 * held + 0.2 * top if asked else 0.65 * held + 0.35 * top
    full = concept is not None and concept >= 0.99
    return max(intent, 0.7) if full else intent, top, match, full or intent >= 0.4


def test_coverage_is_the_plain_one(spark):
    rng = random.Random(9)
    words = ["retention", "ret", "reta", "policy", "polished", "vpn", "q", "zebra", "zeb", "annual", "x" * 600]
    text = lambda: rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 4)))])
    rows = [(i, rng.sample(words, rng.randrange(4)), text(), text(), rng.sample("ABC", rng.randrange(3)), rng.sample("ABC", rng.randrange(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, terms array<string>, evidence string, answer string, asked array<string>, known array<string>")
    for r in df.select("i", E.coverage(*(F.col(c) for c in df.columns[1:])).alias("s")).collect():
        want = covered(*rows[r.i][1:])
        assert all(abs(a - b) < 1e-4 for a, b in zip(r.s[:3], want[:3], strict=True)) and r.s.covered == want[3], rows[r.i]


def sureness(kind, qc, cc, g, u, i, s, m, order, red, d, b):
    base = 0.18 * qc + 0.12 * cc + 0.18 * g + 0.1 * b + 0.08 * d + 0.08 * (1 - u) + 0.06 * (1 if order else 0.4) + 0.12 * i + 0.05 * s + 0.03 * m - min(0.25, 0.05 * red) - (0 if order else 0.14)
    base = min(1, max(0, base))
    if kind == "no_evidence":
        return 0.03
    if kind in ("explicit_refusal", "related_not_answering"):
        x = 0.12 if i < 0.35 else 0.15
        return min(0.20, x + 0.05) if kind == "explicit_refusal" and i >= 0.45 else x
    if kind == "partial":
        x = min(1, max(0, min(1, max(0, 0.58 + 0.22 * base - 0.1 * (1 - i))) - 0.04))
        return 0.7 + 0.08 * g if x > 0.78 else 0.45 + 0.1 * g if x < 0.45 else x
    if qc >= 0.85 and g >= 0.8 and i >= 0.7 and u <= 0.05 and s >= 0.4 and order:
        base = min(0.98, max(base, 0.92) + 0.03)
    elif i < 0.55 or s < 0.3:
        base = min(base, 0.55)
    return base if order else min(base, 0.78)


def test_confidence_is_the_plain_one(spark):
    rng = random.Random(1)
    x = lambda: rng.choice([0.0, 0.25, 0.5, 0.86, 1.0, 1.0])
    kinds = ["no_evidence", "explicit_refusal", "related_not_answering", "partial", "complete", "complete"]
    rows = [(k, rng.choice(kinds), x(), x(), x(), rng.choice([0.0, 0.0, 0.5]), x(), x(), x(), rng.random() < 0.8, rng.randrange(7), x(), x()) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, kind string, qc double, cc double, g double, u double, i double, s double, m double, o boolean, r int, d double, b double")
    labels = set()
    for r in df.select("k", E.confidence(*(F.col(c) for c in df.columns[1:])).alias("s")).collect():
        want = sureness(*rows[r.k][1:])
        assert abs(r.s.confidence - want) < 1e-5, rows[r.k]
        assert r.s.label == ("high" if r.s.confidence >= 0.8 else "medium" if r.s.confidence >= 0.55 else "low")
        assert 0 <= r.s.reliability <= 1
        labels.add(r.s.label)
    assert labels == {"high", "medium", "low"}


def test_answers(spark):
    rows = [
        (1, "How much annual leave may employees take?", "Employees may take thirty days of annual leave each year in total.", "Employees may take thirty days of annual leave each year."),
        (2, "What about the vpn and the budget?", "The vpn is open to employees who travel and to the budget committee.", "The vpn is open to employees who travel for the firm."),
        (3, "How much annual leave may employees take?", None, "Thirty days."),
        (4, "How much annual leave may employees take?", "Annual leave of employees is thirty days and more.", "I could not find it."),
        (5, "Which zebra jumps quickly over fences?", "Nothing here mentions what one looks for: 12 34", "One cannot say."),
    ]
    out = {r.k: r for r in P.judged_answers(spark.createDataFrame(rows, "k int, question string, evidence string, answer string"), ["k"]).collect()}
    assert [out[k].completeness for k in range(1, 6)] == ["complete", "partial", "no_evidence", "explicit_refusal", "related_not_answering"]
    assert out[1].label == "high" and out[1].confidence > out[2].confidence > out[4].confidence > out[3].confidence
    assert P.judged_answers(spark.createDataFrame([], "k int, question string, evidence string, answer string"), ["k"]).count() == 0
