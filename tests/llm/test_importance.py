import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from lodestack.llm import op11_importance
from lodestack.llm.importance import importance_resample


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def features(text, n_buckets=10_000):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % n_buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5, least=20, n_buckets=10_000):
    s, t = Counter(b for _, x in docs for b in features(x, n_buckets)), Counter(b for x in target for b in features(x, n_buckets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + n_buckets) / ((s[b] + 1.0) * (all_t + n_buckets)))) for b in range(n_buckets)]
    out = []
    for d, x in docs:
        f = features(x, n_buckets)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    can = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(can[: len(can) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_query_agrees_with_sql_and_brute_force(spark, sf_dir):
    rows = got(op11_importance.run(spark, sf_dir))
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert rows == sorted(c.sql(op11_importance.SQL).fetchall(), key=repr)
    assert rows == brute(c.sql("SELECT doc_id, text FROM documents").fetchall(), [x for (x,) in c.sql("SELECT text FROM benchmark").fetchall()])


def test_odd_rows(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["naïve", "The", "ein", "x1", "日本"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    docs = [*enumerate(texts), (500, None), (501, ""), (502, "..!"), (503, "one"), (504, "two words"), (505, "a b c " * 20_000), (None, "null id " * 20), (7, texts[7]), (7, texts[7])]
    target = ["The naïve ein", None, "", "x1 The 日本 The"]
    frame = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, buckets string, score int")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance_resample(frame, wanted, percent=30, n_buckets=50)
    assert got(out) == brute(docs, target, percent=30, n_buckets=50)
    assert set(out.columns) == {"doc_id", "buckets", "n_words", "n_features", "weight", "score", "rank"}
    assert got(importance_resample(frame, wanted.limit(0), percent=100, n_buckets=50)) == brute(docs, [], percent=100, n_buckets=50)
    assert got(importance_resample(frame.limit(0), wanted)) == []
    with pytest.raises(ValueError):
        importance_resample(frame, wanted, percent=101)


def test_draw_moves_towards_the_target(spark):
    rng = random.Random(5)
    alike = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(40))) for i in range(0, 50)]
    other = [(i, " ".join(rng.choice(["red", "green", "blue"]) for _ in range(40))) for i in range(50, 500)]
    frame = spark.createDataFrame(alike + other, "doc_id long, text string")
    drawn = importance_resample(frame, spark.createDataFrame([("alpha beta gamma beta",)] * 20, "text string"), percent=10).where("rank IS NOT NULL")
    assert {r.doc_id for r in drawn.collect()} == set(range(50))


def test_buckets_of_documents_are_made_once(spark, monkeypatch):
    """Documents were taken apart for the counts and again for the scores."""
    import lodestack.llm.importance as m

    made, plain = [], m.bucket_arrays
    monkeypatch.setattr(m, "bucket_arrays", lambda *a: made.append(a) or plain(*a))
    docs = [(i, f"a b c d{i} e f") for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(importance_resample(frame, spark.createDataFrame([("b c e",)], "text string"), least_words=2, id_col="DOC_ID")) == brute(docs, ["b c e"], least=2)
    assert len(made) == 2, "once for the documents and once for the target"
