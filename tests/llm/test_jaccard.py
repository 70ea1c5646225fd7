import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import jaccard, op10_jaccard
from lodestack.llm.components import components
from lodestack.llm.jaccard import forest, linked, similar_documents
from lodestack.llm.partenum import bands, instances, may_be_similar, pair_may_be_similar, shingle_sets, signatures, similar, sketch, sketch_bits


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(docs, percent=85, width=4):
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=repr)


def found(frame, **how):
    return sorted((tuple(r)[:3] for r in similar_documents(frame, **how).collect()), key=repr)


def near_copies(rng, n, words, share, start):
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(max(1, int(words * share)))):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((start + i, " ".join(w)))
    return out


def test_query_agrees_with_sql(spark, sf_dir):
    got = sorted(map(tuple, op10_jaccard.run(spark, sf_dir).collect()))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(c.sql(op10_jaccard.SQL).fetchall())


def test_shingles_agree_with_plain_words():
    odd = ["", None, " \t\n", "a", " a b\n", "A b C d", "a  b\x0bc\td\r\ne", "é É ß x y z", "x y z é É ß", "\x1c a\x85b c d", "a b c", "c b a", "w " * 500]
    got = shingle_sets(pa.array(odd))
    plain = [shingles(t) for t in odd]
    assert [len(s) for s in got] == [len(s) for s in plain]
    for i, a in enumerate(plain):
        for j, b in enumerate(plain):
            assert len(np.intersect1d(got[i], got[j])) == len(a & b)


@pytest.mark.parametrize("percent", [85, 50, 99])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for size in [1, 2, 3, 5, 6, 7, 8, 9, 10, 12, 13, 14, 20, 21, 30, 31, 47, 48, 70, 100, 160, 300, 700, 3000]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            drop = rng.integers(0, len(a) + 1)
            add = rng.integers(0, len(a) + 2)
            # the hardest sets that still count: as many differing features as the threshold lets in
            while drop + add and 100 * (len(a) - drop) < percent * (len(a) + add):
                if drop and (not add or rng.random() < 0.5):
                    drop -= 1
                else:
                    add -= 1
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            assert similar(a, b, percent) or not len(b)
            if similar(a, b, percent) and set(a.tolist()) != set(b.tolist()):
                s, o = signatures([a, b], percent)
                assert len(np.intersect1d(s[o == 0], s[o == 1])), (size, drop, add)


@pytest.mark.parametrize("size", [6, 7, 9, 12, 15, 18, 30])
def test_unrelated_sets_do_not_meet(size):
    rng = np.random.default_rng(size)
    sets = list(np.sort(rng.integers(0, 2**63, (20_000, size)).astype(np.uint64), axis=1))
    for percent in (85, 80):
        sig, owner = signatures(sets, percent)
        _, count = np.unique(sig, return_counts=True)
        assert count.max() <= 2, percent  # below 0.01 % of 20,000 under any key
        assert len(np.unique(owner)) == len(sets) and len(sig) < 40 * len(sets)


def test_bands_cover_all_sizes_and_pairs():
    found = bands(5000, 85)
    assert found[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(found, found[1:]))
    for a in range(1, 400):
        for b in range(a, 480):
            if 100 * a >= 85 * b and 15 * (a + b) // 185 >= 1:
                assert {n for n, _, _ in instances(a, 85)} & {n for n, _, _ in instances(b, 85)}, (a, b)


@pytest.mark.parametrize("unit,outsiders", [(512, 256), (7, 3)])
def test_near_copies_and_odd_rows(spark, monkeypatch, unit, outsiders):
    monkeypatch.setattr(jaccard, "UNIT", unit)
    monkeypatch.setattr(jaccard, "OUTSIDERS", outsiders)
    monkeypatch.setattr(jaccard, "DENSE", unit)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0 if unit < 10 else 10**6)
    rng = random.Random(3)
    docs = near_copies(rng, 60, 200, 0.06, 0) + near_copies(rng, 40, 60, 0.12, 1000) + near_copies(rng, 30, 12, 0.2, 2000) + near_copies(rng, 3, 6000, 0.02, 3000)
    docs += [(i, " ".join(f"r{rng.randrange(10**5)}" for _ in range(rng.randrange(1, 80)))) for i in range(4000, 4060)]
    docs += [(5000, ""), (5001, None), (5002, " "), (5003, "one"), (5004, "ONE"), (5005, "two words"), (None, "two words"), (None, "alone here with null"), (5006, "one"), (5006, "one"), (None, ""), (-7, docs[5][1]), (5010, docs[70][1] + "  ")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, set string, leader int")
    assert found(frame) == brute(docs)


def test_matrix_counts_as_pairs_do():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: 400 - i], rng.integers(0, 2**63, i).astype(np.uint64)]) for i in range(90)] + [np.empty(0, np.uint64)]
    want = np.array([[i != j and similar(a, b, 85) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (linked(sets, 85) == want).all()
    part = linked(sets, 85, 20)
    assert (part[:20, 20:] == want[:20, 20:]).all() and not part[:20, :20].any() and not part[20:, 20:].any()
    assert sorted(forest(np.array([9, 4, 6, 1]), np.array([[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]], bool))) == [(9, 4)]


@pytest.mark.parametrize("percent", [85, 80, 50])
def test_sketches_lose_no_similar_pair(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for size in (1, 2, 5, 31, 32, 33, 64, 100, 129, 500):
        base = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        for _ in range(6):
            keep = rng.permutation(base)[: max(1, int(size * (1 - rng.random() * 0.4)))]
            sets.append(np.unique(np.r_[keep, rng.integers(0, 2**63, int(rng.random() * 0.3 * size)).astype(np.uint64)]))
    assert all(len(sketch(s)) * 8 == sketch_bits(len(s)) for s in sets)
    near = may_be_similar(np.array([len(s) for s in sets]), [sketch(s) for s in sets], percent)
    want = np.array([[i != j and similar(a, b, percent) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert not (want & ~near).any() and near.sum() < len(sets) ** 2 / 2
    for i in range(0, len(sets), 5):
        for j in range(i):
            pair = [sets[i], sets[j]]
            assert pair_may_be_similar(tuple(map(len, pair)), tuple(map(sketch, pair)), percent) == may_be_similar(np.array([len(s) for s in pair]), [sketch(s) for s in pair], percent)[0, 1]
    by_size = [s for s in sets if len(s) > 90]
    near = may_be_similar(np.array([len(s) for s in by_size]), [sketch(s) for s in by_size], percent)
    assert near.sum() <= 3 * sum(similar(a, b, percent) for i, a in enumerate(by_size) for j, b in enumerate(by_size) if i != j) + 20


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    rest = [(5000, 5000), (None, 3), (7000, 7001), (7001, 7000), (7001, 7000)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in chain + star + rest if a is not None]
    rng.shuffle(edges)
    got = dict(components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 7000: 7000, 7001: 7000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
