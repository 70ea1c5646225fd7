"""Sets of words that are alike, against brute force, and what they shuffle."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestack.operators import knowledge as K
from lodestack.operators import likesets as L


def shuffled(spark) -> int:
    """Bytes that all stages so far have shuffled."""
    context = spark.sparkContext
    jvm, gateway = context._jvm, context._gateway
    context._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def some_sets(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    sets = [set(rng.sample(words, rng.choice((1, 2, 5, 20, 70)))) for _ in range(n)] + [{"only"}, {f"own{i}" for i in range(9)}]
    for s in list(sets[:70]):
        for _ in range(rng.randrange(3)):
            sets.append((s - set(rng.sample(sorted(s), len(s) // 9))) | set(rng.sample(words, len(s) // 9)))
    return sets + [set(), set(sets[0]), set(sets[1])]


@pytest.mark.parametrize("percent", [72, 100, 40])
def test_peers_are_those_of_brute_force(spark, monkeypatch, percent):
    sets = some_sets(percent)
    table = spark.createDataFrame([(7 * i - 90, sorted(s)) for i, s in enumerate(sets)], "doc long, terms array<string>").repartition(3)
    monkeypatch.setattr(L, "PART_WORDS", 700)  # several parts of words
    monkeypatch.setattr(L, "MEET_WORDS", 900)
    monkeypatch.setattr(L, "BUCKET_WORDS", 400)
    got = {r.doc: (r.class_id, r.n_peers) for r in K.similar_classes(table, "doc", percent).collect()}
    want = {}
    for i, a in enumerate(sets):
        near = sum(j != i and bool(a) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets))
        want[7 * i - 90] = (7 * (sets.index(a) if a else i) - 90, near)
    assert got == want and max(n for _, n in want.values()) > 1


def test_pairs_are_looked_at_some_at_a_time(spark, monkeypatch):
    """The functions that tasks run, as they are here, with hardly any room."""
    monkeypatch.setattr(L, "PAIRS", 3)
    monkeypatch.setattr(L, "SHARD_WORDS", 40)
    sets = [s for s in some_sets(5) if s]
    held = {frozenset(s): i for i, s in reversed(list(enumerate(sets)))}
    once = [(i, sorted(s)) for s, i in held.items()]
    grouped = lambda table, by: [(k, table.filter(pa.compute.equal(table[by], k))) for k in sorted(set(table[by].to_pylist()))]
    stages = []

    class Frame:  # keeps the functions handed to Spark
        def __getattr__(self, name):
            return lambda *a: (name.endswith("InArrow") and stages.append(a[0])) or self

    L._numbered(Frame()), L._numbers(Frame(), 3, 4), L._leads(Frame(), 2, 72), L._met(Frame(), 72)
    number, numbers, leads, met = stages
    shards = [L._shard(n, np.array([i for i, _ in once[n::4]]), pa.array([t for _, t in once[n::4]], pa.list_(pa.string())), 3) for n in range(4)]
    numbered = pa.concat_tables(number((pa.scalar(k),), t) for k, t in grouped(pa.concat_tables(shards), "part"))
    own = pa.concat_tables(numbers(t) for _, t in grouped(numbered, "shard"))
    led = pa.Table.from_batches(leads(own.combine_chunks().to_batches()))
    found = set()
    for _, t in grouped(led, "part"):
        out = met(t)
        for x, y, bucket in zip(out["x"].to_pylist(), out["y"].to_pylist(), out["bucket"].to_pylist()):
            found |= set(zip(np.frombuffer(x, np.int64).tolist(), np.frombuffer(y, np.int64).tolist()))
    close = {(i, j) for a, i in held.items() for b, j in held.items() if i < j and 100 * len(a & b) >= 72 * len(a | b)}
    assert len(close) > 15 and close <= found and len(found) < 2 * len(close)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    n = np.array([0, 5, 0, 1, 300, 0])
    numbers = np.concatenate([np.sort(rng.choice(2**45, k, replace=False)) for k in n])
    got, sizes = L.unpacked(pa.chunked_array([pa.array(L.packed(numbers, n), pa.binary())]))
    assert (got == numbers).all() and (sizes == n).all()
    assert L.unpacked(pa.array([], pa.binary()))[0].size == 0


def test_a_set_is_not_shuffled_for_each_pair(spark):
    """Each pair that met was shuffled with the words of both sets."""
    rng = random.Random(4)
    words = [f"word{rng.randrange(10**9)}" for _ in range(2000)]
    rows = [(i, sorted(set(words) - {words[i]})) for i in range(40)]
    before = shuffled(spark)
    table = spark.createDataFrame(rows, "doc long, terms array<string>")
    assert {r.n_peers for r in K.similar_classes(table, "doc", 72).collect()} == {39}
    print("bytes shuffled", shuffled(spark) - before)
    assert shuffled(spark) - before < 1_500_000
