"""Stacked tables and blocks of documents, against plain loops over all lines of all documents."""

import random
import re
import statistics

from pyspark.sql import functions as F

from lodestack.functions.fixed import BOUNDARY
from lodestack.operators import ingestion as I
from lodestack.operators import passages as A
from lodestack.plans import passages as P


def words(x):
    return re.split(r"\s+", x)


def prose(x):
    return len(x) > 100 or x.count(". ") >= 2 or bool(re.search("[.!?]", x)) and len(words(x)) > 12


def marks(x):
    return len(re.findall("[,.;:!?]", x)) / len(x)


def header(x):
    return len(x) <= 50 and not (";" in x and len(x) > 30) and not (x.endswith(".") and len(words(x)) > 6)


def steps(x, *levels):
    return next((cost for at, cost in levels if x >= at), 0.0)


def confidence(heads, rows):
    cells = [*heads, *(c for r in rows for c in r)]
    body = [c for r in rows for c in r]
    share = lambda f, xs: sum(map(bool, map(f, xs))) / len(xs)
    spread = lambda xs: statistics.pstdev(xs) / statistics.fmean(xs)
    step = lambda x, a, b: 1.0 if x <= a else 0.6 if x <= b else 0.2
    like = statistics.fmean(max(0, 1 - 0.4 * (len(h) > 50) - 0.5 * prose(h) - 0.3 * (marks(h) > 0.08) - 0.2 * (len(words(h)) > 8)) for h in heads)
    mean = statistics.fmean(map(len, cells))
    short = 0.20 if mean <= 28 else 0.15 if mean <= 45 else 0.08 if mean <= 70 else -0.10
    numbers = share(lambda c: re.search(r"\d", c), body)
    aligned = statistics.fmean(step(spread([len(r[j]) for r in rows]), 0.35, 0.7) for j in range(len(heads)))
    widths, counts = [sum(map(len, r)) for r in rows], [sum(len(words(c)) for c in r) for r in rows]
    narrative = share(lambda c: (";" in c and len(c) > 35) or (" while " in c.lower() and len(c) > 60) or " reflects " in c.lower(), cells)
    p, marked = share(prose, cells), share(lambda c: marks(c) > 0.06, cells)
    reward = 0.22 * like + short + 0.18 * aligned + 0.15 * step(spread(counts), 0.45, 0.9) + 0.10 * (1.0 if numbers >= 0.35 else 0.6 if numbers >= 0.15 else 0.0) + 0.10
    penalty = steps(share(lambda c: len(c) > 80, cells), (0.25, 0.25)) + steps(p, (0.20, 0.30)) + steps(p, (0.40, 0.20)) + steps(narrative, (0.20, 0.35), (0.10, 0.18))
    penalty += steps(marked, (0.35, 0.25), (0.20, 0.12)) + steps(spread(widths), (1.0, 0.20), (0.7, 0.10)) + steps(sum(x > 220 for x in widths) / len(widths), (0.30, 0.20))
    return round(min(1.0, max(0.0, reward - penalty)), 6)


def plain(lines, taken=(), least=0.55):
    """lines: stripped; returns (start, end, columns, rows, confidence) of stacked tables."""
    stop = lambda i: lines[i] == "" or i in taken or re.search(f"(?i){BOUNDARY}", lines[i]) or len(lines[i]) > 120 or (lines[i].count(". ") >= 2 and len(words(lines[i])) > 18)
    out, i = [], 0
    while i < len(lines):
        best = None
        for c in range(2, 7):
            heads = range(i, i + c)
            if i + c > len(lines) or any(lines[j] == "" or j in taken or not header(lines[j]) for j in heads):
                continue
            end = i + c
            while end < len(lines) and not stop(end) and end - i - c < 25 * c:
                end += 1
            n = end - i - c
            if n < 2 * c or n % c:
                continue
            rows = [lines[k : k + c] for k in range(i + c, end, c)]
            sure = confidence(lines[i : i + c], rows)
            if best is None or sure > best[4]:
                best = (i, end - 1, c, len(rows), sure)
        if best and best[4] >= least:
            out.append(best)
            i = best[1] + 1
        else:
            i += 1
    return out


HAND = [
    "Name\nCount\nAlpha\n5\nBeta\n7",
    "Name\nCount\nAlpha\n5\nBeta",
    "A\nB\nC\n1\n2\n3\n4\n5\n6\n\nKey\nValue\nk1\n10\nk2\n20\nk3\n30",
    "Name\nCount\nAlpha\n5\nBeta\n7\n3. Next part\nHead\nTail\na\n1\nb\n2",
    "\n".join(["H1", "H2"] + [f"v{i}" for i in range(130)]),
    "One\nTwo\n" + "long prose that goes on. and on. and more of it here; while it reflects all of this and that\n" * 4,
    "A\nB\n" + "x" * 130 + "\nC\nD\n1\n2\n3\n4",
    "", "one line", "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk\nl",
    "Name  Count\nAlpha  1\nBeta  2\nOwner\nShare\nAnn\n40\nBo\n60",
]


def got(rows, gaps):
    return {(r.doc_id, r.start, r.end, r.columns, r.data_rows, round(r.confidence, 6)) for r in A.stacked_tables(rows, gaps, 0.55).collect()}


def lines_of(rows):
    out = {}
    for r in rows.select("doc_id", "at", F.trim("line").alias("x")).orderBy("doc_id", "at").collect():
        out.setdefault(r.doc_id, []).append(r.x)
    return out


def test_hand_made_tables(spark):
    rows = I.lines(spark.createDataFrame(list(enumerate(HAND)), "doc_id long, text string"))
    gaps = A.tables(rows).where("confidence >= 0.55").select("doc_id", "start", "end")
    taken = {}
    for r in gaps.collect():
        taken.setdefault(r.doc_id, set()).update(range(r.start, r.end + 1))
    want = {(d, *t) for d, x in lines_of(rows).items() for t in plain(x, taken.get(d, ()))}
    assert got(rows, gaps) == want
    assert {w[0] for w in want} >= {0, 2, 3, 4, 10}
    assert got(rows.limit(0), gaps.limit(0)) == set()


def test_all_documents(spark, sf_dir):
    rows = P.stacked(spark, sf_dir)
    gaps, found = P.all_tables(rows)
    taken = {}
    for r in gaps.select("doc_id", "start", "end").collect():
        taken.setdefault(r.doc_id, set()).update(range(r.start, r.end + 1))
    want = {(d, *t) for d, x in lines_of(rows).items() for t in plain(x, taken.get(d, ()))}
    assert {(r.doc_id, r.start, r.end, r.columns, r.data_rows, round(r.confidence, 6)) for r in found.collect()} == want
    assert len(want) >= 2 * rows.select("doc_id").distinct().count()


def test_each_line_is_in_one_block(spark, sf_dir):
    rows = P.stacked(spark, sf_dir)
    found = {}
    for r in P.document_blocks(spark, sf_dir).collect():
        for at in range(r.start, r.end + 1):
            assert (r.doc_id, at) not in found, r
            found[r.doc_id, at] = r.kind
    filled = {(r.doc_id, r.at) for r in rows.where("NOT blank").select("doc_id", "at").collect()}
    assert set(found) == filled
    assert set(found.values()) == {"heading", "table", "list", "paragraph"}


def test_covering_and_gaps(spark):
    text = "SUMMARY\nfirst line\nsecond line\n\nthird line\n- one\n- two\nOwner\nShare\nAnn\n40\nBo\n60\n\nlast words here."
    rows = I.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    tables = A.stacked_tables(rows, spark.createDataFrame([], "doc_id long, start int, end int"), 0.55)
    blocks = [(r.start, r.end, r.kind, r.lines) for r in A.blocks(I.headings(rows), tables, A.lists(rows)).orderBy("start").collect()]
    assert [b for b in blocks if b[2] == "table"] == [(t[0], t[1], "table", t[1] - t[0] + 1) for t in plain(text.split("\n"))]
    assert blocks[0] == (0, 0, "heading", 1) and (1, 2, "paragraph", 2) in blocks
    assert sum(b[3] for b in blocks) == sum(x != "" for x in text.split("\n"))


def test_links_are_the_plain_ones(spark):
    rng = random.Random(6)
    pieces = [(d, 3 * i, *rng.choice([("paragraph", None), ("table", None), ("heading", 1), ("heading", 2), ("heading", 3), ("heading", 9)])) for d in range(12) for i in range(rng.randrange(1, 30))]
    want = []
    for d, start, kind, level in pieces:
        above = [(s, min(x, 6)) for e, s, k, x in pieces if e == d and s < start and k == "heading" and (kind != "heading" or min(x, 6) < min(level, 6))]
        want.append((d, start, max((s for s, _ in above), default=None), min((s for e, s, *_ in pieces if e == d and s > start), default=None)))
    out = A.links(spark.createDataFrame(pieces, "doc_id long, start int, kind string, heading_level int")).collect()
    assert sorted(((r.doc_id, r.start, r.parent, r.next) for r in out), key=repr) == sorted(want, key=repr)
