import duckdb
import pytest

from lodestack.llm import op6_decontamination
from lodestack.llm import winnowing
from lodestack.llm.winnowing import contamination


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        n = min(len(w), window)
        for a in range(len(w) - n + 1):
            wins.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in wins:
                    hit |= set(range(a, a + n))
                    ids |= wins[k]
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def found(docs, items, window):
    rows = contamination(docs, items, window).collect()
    for r in rows:
        assert r.n_hit == sum(e - b for b, e in r.spans) and all(x.end < y.begin for x, y in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in rows), key=repr)


def test_query_agrees_with_sql(spark, sf_dir):
    got = sorted(map(tuple, op6_decontamination.run(spark, sf_dir).collect()))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert got == sorted(c.sql(op6_decontamination.SQL).fetchall())
    assert sum(r[-1] for r in got) > 0


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again today"), (2, "a a a a a a a a a a a a"), (3, "short one"), (4, "É é ß 7up"), (5, ""), (6, None), (None, "quick brown fox jumps over the lazy dog again"), (7, "the LAZY dog again and again today it was so"), (1, "one more text of item one that is longer than ten words here"), (8, "x")]
DOCS = [
    (1, "xx the QUICK, brown fox; jumps over the lazy dog again and-again today!! yy"),
    (2, "a " * 30),
    (3, "it was a short\none. a short one"),
    (3, "it was a short\none. a short one"),
    (4, "É É ß 7up é É é ß 7up"),
    (5, ""),
    (6, None),
    (None, "quick brown fox jumps over the lazy dog again and again"),
    (7, "the lazy dog again and again today it was"),
    (8, "--- ..."),
    (9, "quick brown fox jumps over the lazy dog again and " * 400),
    (10, "b x"),
]


@pytest.mark.parametrize("window", [10, 3, 1])
@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_odd_rows(spark, window, broadcast, monkeypatch):
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", broadcast)
    docs = spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id long, text string, n_hit int, win string")
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, doc_id int")
    assert found(docs, items, window) == brute(DOCS, ITEMS, window)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(docs.limit(0), items, 10) == []
    assert found(docs, items.limit(0), 10) == brute(DOCS, [], 10)
