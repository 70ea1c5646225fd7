import hashlib

import pytest

from lodestack.llm import op9_warc
from lodestack.llm.store import new_path
from lodestack.llm.warc import END, VERSION, candidates, decide, reachable, read_archives, write_archives

INNER = f"{VERSION}WARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5{END}hello"
PAGES = [
    (1, "http://a/1", "x" * 200),
    (2, "http://a/2\r\nWARC-Type: evil", "x" * 200),
    (0, None, "y" * 99),
    (3, "http://é/", "y" * 99),
    (4, "u", None),
    (5, "u", ""),
    (6, "u", f"text {VERSION} more {END} text {VERSION}"),
    (7, "u", f"whole record inside {INNER}{END}{INNER}{END} tail"),
    (8, "u", INNER),
    (9, "u", f"ends with one {INNER}"),
    (9, "v", f"{END}{END}"),
    (None, "u", "n" * 300),
    (20, "u", "n" * 300),
    (-5, "u", "ü" * 60 + END),
    (-4, "u", "ü" * 60 + END),
    (30, "r", "r" * 150),
    (30, "r", "r" * 150),
    (30, "s", "r" * 150),
    (31, "s", "r" * 150),
]


def brute(pages):
    first, seen, out = {}, set(), []
    for p, _, html in pages:
        h = (html or "").encode()
        if len(h) >= 100:
            first[h] = min(first.get(h, (True, 1)), (p is None, p or 0))
    for p, _, html in pages:
        h = (html or "").encode()
        kind, to = "response", None
        if len(h) >= 100:
            null, smallest = first[h]
            if (p is None, p or 0) != (null, smallest) or h in seen:
                kind, to = "revisit", None if null else smallest
            else:
                seen.add(h)
        out.append((p, len(h), hashlib.sha256(h).hexdigest(), kind, to))
    return sorted(out, key=repr)


def read(spark, path):
    rows = read_archives(spark, path).collect()
    page = lambda u: None if u is None or u.split(":")[2] == "none" else int(u.split(":")[2])
    ids = {r.record_id: r for r in rows}
    assert len(ids) == len(rows)
    assert all(ids[r.refers_to].record_type == "response" and ids[r.refers_to].payload_digest == r.payload_digest for r in rows if r.record_type == "revisit")
    assert all(r.intact is (None if r.record_type == "revisit" else True) for r in rows)
    return sorted(((page(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, page(r.refers_to)) for r in rows), key=repr)


def test_query_agrees_with_brute_force(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, op9_warc.run(spark, sf_dir).collect()), key=repr) == brute(pages)


@pytest.mark.parametrize("split", ["128m", "700b"])
@pytest.mark.parametrize("copies", [1, 40])
def test_magic_inside_payloads_and_odd_rows(spark, split, copies, monkeypatch):
    monkeypatch.setattr("lodestack.llm.warc.BROADCAST_ROWS", copies)
    pages = PAGES + [(1000 + i, "u", f"{i} {INNER} {i}") for i in range(copies)]
    docs = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, record_type int").coalesce(2)
    path = new_path(spark, "t")
    write_archives(decide(docs), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert read(spark, path) == brute(pages)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pointers_into_a_run_and_broken_chains(spark):
    rows = [("f", 0, 0, 50), ("f", 0, 10, 20), ("f", 0, 20, 50), ("f", 0, 50, 60), ("f", 0, 60, 99), ("g", 0, 5, 9), ("g", 0, 9, 20), ("h", 0, 0, None), ("h", 0, 30, 40), ("f", 9, 99, 120), ("f", 9, 110, 120), ("f", 9, 120, 130)]
    found = spark.createDataFrame(rows, "file string, split long, start long, next long")
    assert sorted((r.file, r.start) for r in reachable(found).collect()) == [("f", 0), ("f", 50), ("f", 60), ("f", 99), ("f", 120), ("h", 0)]


def test_files_without_a_first_record(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"junk" + INNER.encode() + END.encode())
    (tmp_path / "b.warc").write_bytes((INNER + END).encode()[:-20])
    (tmp_path / "c.warc").write_bytes((INNER + END + INNER).encode()[:-3])
    rows = read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.file[-6:], r.start, bool(r.intact)) for r in rows) == [("b.warc", 0, False), ("c.warc", 0, False), ("c.warc", len(INNER + END), False)]


def test_empty_table(spark):
    path = new_path(spark, "t")
    write_archives(decide(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert read_archives(spark, path).collect() == []
    assert candidates(spark, path).count() == 0
