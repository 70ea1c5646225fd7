import duckdb
import pytest

from lodestack.llm import op8_mixing
from lodestack.llm.mixing import mix, ordered_mix, schedule
from lodestack.llm.store import numbered, written


def test_query_agrees_with_sql(spark, sf_dir):
    got = sorted(map(tuple, op8_mixing.run(spark, sf_dir).collect()))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(c.sql(op8_mixing.SQL).fetchall())


def test_every_source_gets_its_blocks_evenly(spark):
    sources = written(numbered(spark.createDataFrame([("a", 700), ("b", 200), ("c", 0), ("d", 1)], "key string, blocks long"), "key", sums=("blocks",)), "t")
    rows = schedule(sources).orderBy("slot").collect()
    for key, n in (("a", 700), ("b", 200), ("d", 1)):
        mine = [r for r in rows if r.key == key]
        assert [r.block for r in mine] == list(range(n))
    for upto in (64, 256, 512):
        part = [r for r in rows if r.slot < upto]
        assert abs(sum(r.key == "a" for r in part) - 700 * upto / 1024) <= 6
    assert len({r.slot for r in rows}) == 901


def test_the_mix_comes_through_its_schedule(spark, sf_dir):
    """The pieces in order are the blocks of the schedule, each filled with its source's words in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces, stream = ordered_mix(docs, block_words=64)
    rows = {r.place: r for r in stream.collect()}
    by_slot = {}
    for p in sorted(pieces.collect(), key=lambda p: (p.slot, p.at)):
        assert 0 <= p.first and p.first + p.words <= rows[p.place].size
        by_slot.setdefault(p.slot, []).append(p)
    last, due = {}, {r.source: int(r.target) for r in rows.values()}
    for slot in sorted(by_slot):
        own = by_slot[slot]
        (source,) = {rows[p.place].source for p in own}
        begin = last.get(source, 0)
        assert own[0].at == begin and all(a.at + a.words == b.at for a, b in zip(own, own[1:]))
        last[source] = begin + sum(p.words for p in own)
        assert last[source] - begin == min(64, due[source] - begin)
    assert last == {s: d for s, d in due.items() if d}
    # Any stretch of the mix has the sources in their shares.
    half = sorted(by_slot)[: len(by_slot) // 2]
    for source, d in due.items():
        assert abs(sum(p.words for s in half for p in by_slot[s] if rows[p.place].source == source) - d / 2) <= 64 * 8


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 9, 9), (2, "d", "y", 9, 9)], "doc_id long, text string, source string, slot int, place int")
    assert sorted((r.doc_id, r.size) for r in mix(docs).collect()) == [(1, 3), (2, 1)]


def test_odd_rows(spark):
    rows = [(1, "a b c", "x", 0), (1, "a b c", "x", 0), (None, "w " * 500, None, 0), (2, None, "x", 0), (3, "", "é", 0), (4, " \t ", "z", 0), (5, "one two", "Z", 0)] + [(9, "hot row", "x", 0)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(docs, block_words=4).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and 0 <= r.copies <= 2 and len(r.spots) == r.copies and None not in r.spots
        assert (r.n_pieces > 0) == (r.first_slot is not None) == (r.taken > 0)
        by.setdefault((r.source, r.source_size, r.target), []).append(r.taken)
    assert all(sum(v) == int(k[2]) for k, v in by.items())
    sizes = {k[0]: k[1] for k in by}
    assert sizes == {"x": 66, None: 500, "é": 0, "z": 0, "Z": 2}
    assert sum(k[2] for k in by) == pytest.approx(1.5 * 568)
    assert sorted(map(tuple, mix(docs, block_words=4).select("doc_id", "size", "taken").collect()), key=repr) == sorted(((r.doc_id, r.size, r.taken) for r in got), key=repr)


def test_empty_table_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.target, r.taken, r.copies) for r in mix(blank).collect()) == [(1, 0.0, 0, 0), (2, 0.0, 0, 0)]
    with pytest.raises(ValueError):
        mix(empty, share=3.0, cap=2)
