import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as cp  # noqa: E402
from test_jaccard import brute as brute_components  # noqa: E402
from test_winnowing import brute as brute_contamination  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    from lodestack.llm.store import written

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in cp.STAGES:
        found = written(f(spark, docs, SF), "t")
        out.append((name, docs, found))
        docs = found
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    assert all(found.columns == cp.COLUMNS for _, _, found in stages[:-1])
    assert stages[-1][2].columns == [*cp.COLUMNS, "size", "text_crc32", "shard", "slot"]


def test_classifier_keeps_good_documents(spark, stages):
    _, docs, found = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept, every = rows(found), rows(docs)
    good = [d for d in every if labels.get(d) == 1]
    bad = [d for d in every if labels.get(d) == 0]
    assert sum(d in kept for d in good) / len(good) > 0.98 and sum(d in kept for d in bad) / len(bad) < 0.1
    assert all(kept[d] == every[d] for d in kept)


def test_one_of_each_group_stays(stages):
    _, docs, found = stages[1]
    every = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d for d, n, c in brute_components(every, 80, 5) if not n or d == c}
    assert set(rows(found)) == want and found.count() == len(want) < len(every)


def test_contaminated_documents_go(spark, stages):
    _, docs, found = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {d for d, _, hit, _ in brute_contamination([(r.doc_id, r.text) for r in docs.collect()], items, 10) if not hit}
    assert set(rows(found)) == want and len(want) < docs.count()


def test_mix_repeats_documents_to_the_weights(stages):
    _, docs, found = stages[3]
    sizes, taken = {}, {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in found.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    due, free, fixed = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        level = (due - sum(fixed.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        fixed |= {s: 2 * sizes[s] for s in over}
        free -= over
    most = max(len(r.text.split()) for r in docs.collect())
    for s in sizes:
        assert abs(taken.get(s, 0) - (fixed.get(s) or level * weight[s])) <= most
    copies = {}
    for r in found.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies.values()) <= {1, 2}


def test_shards_follow_the_order_of_the_mix(stages):
    """The mixed table's order, told anew from the mix of the stage's input, is that of shards and slots."""
    from lodestack.llm.mixing import mix

    _, docs, mixed = stages[3]
    spots = sorted(((s.slot, s.at, r.doc_id) for r in mix(docs).collect() for s in r.spots), key=lambda x: x[:2])
    found = sorted(stages[4][2].select("shard", "slot", "doc_id").collect())
    assert len({x[:2] for x in spots}) > 0.9 * len(spots) and [x[2] for x in spots] != sorted(x[2] for x in spots)
    at = {}
    for k, (slot, begin, d) in enumerate(spots):
        at.setdefault((slot, begin), []).append((k, d))
    groups = [sorted(d for _, d in own) for own in at.values()]
    want, k = [r.doc_id for r in found], 0
    for g in groups:
        assert sorted(want[k : k + len(g)]) == g
        k += len(g)
    assert k == len(want)


def test_shards_are_near_equal(stages):
    _, docs, found = stages[4]
    total = {}
    for r in found.collect():
        total[r.shard] = total.get(r.shard, 0) + r.size
    assert found.count() == docs.count() and set(total) <= set(range(40))
    assert max(total.values()) - min(total.values()) <= 2 * max(r.size for r in found.collect())


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"v{i}" for i in range(40))
    data = [(1, long), (2, long), (2, long), (None, long), (3, None), (3, None), (4, ""), (5, long + " tail"), (6, "own text of six"), (6, "own text of six"), (None, "nameless text here now"), (None, "nameless text here now"), (None, None)]
    docs = spark.createDataFrame([(d, t, None, None if d in (4, None) else "s", 0) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, long)], "item_id long, text string").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = sorted([tuple(r)[:2] for r in cp.near_duplicates(spark, docs, "").collect()], key=repr)
    assert kept == sorted([(1, long), (3, None), (3, None), (4, ""), (6, "own text of six"), (None, "nameless text here now"), (None, None)], key=repr)
    for _, f in cp.STAGES:
        assert f(spark, docs, str(tmp_path)).count() >= 0
        assert f(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert cp.mixing(spark, docs, "").where("doc_id = 6").count() <= 4
