import random
import re

import duckdb
import pytest

from lodestack.llm import op13_urls, urls
from lodestack.llm.urls import judge_urls

RULE = "host string, path string, verdict string"


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")


def brute(url, rules, default="allow"):
    host, path = split(url)
    fit = [(len(h) + len(p or ""), len(h), v, h + (p or "")) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


def test_query_agrees_with_sql(spark, sf_dir):
    rows = sorted(map(tuple, op13_urls.run(spark, sf_dir).collect()), key=repr)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    assert rows == sorted(c.sql(op13_urls.SQL).fetchall(), key=repr)
    assert {r[3] for r in rows} >= {None, "net/", "example.net/en/"}


@pytest.mark.parametrize("n_parts", ["4", "29"])
def test_odd_urls_and_nested_rules(spark, n_parts):
    rng = random.Random(1)
    labels = ["a", "b", "a-b", "", "x\x00y", "é", "com"]
    rules = [(".".join(rng.choice(labels[:3] + labels[5:]) for _ in range(rng.randrange(1, 4))), rng.choice(["", "/", "/a", "/a/", "/a/b", None]), rng.choice(["allow", "block"])) for _ in range(80)]
    pages = [(i, f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randrange(1, 6)))}{rng.choice(['', '/', '/a', '/a/b?/c', '/A/b', '#x', '?a/b'])}") for i in range(600)]
    pages += [(1000 + i, "https://hot.A.com/a/b/" + str(i % 3)) for i in range(400)]  # a hot host
    pages += list(enumerate([None, "", "no scheme", "://", "http:///a", "x://y://z/a", "http://COM/a", "http://a\nb.com/\n", "http://com." + "a." * 5000 + "com/a", "http://a.com:80/a", "http://u@a.com/a"], 5000))
    pages += [(None, "http://com/a"), (1, pages[1][1]), (1, pages[1][1])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n_parts)
    try:
        frame = spark.createDataFrame([(*p, "theirs", [1]) for p in pages], "page_id long, url string, rule string, extra array<int>")
        out = judge_urls(frame, spark.createDataFrame(rules, RULE), default="block")
        assert out.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
        got = sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(((i, u, *brute(u, rules, "block")) for i, u in pages), key=repr)
    assert all(r.extra == [1] for r in out.collect())


def test_keys_make_nested_intervals(spark):
    from pyspark.sql import functions as F

    hosts = ["net", "a.net", "a-b.net", "x.a.net", "anet", "", ".net", "a\x00b.net", "b.a.net"]
    key = {r.h: r.k for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls.host_key(F.col("h")).alias("k")).collect()}
    for one in hosts:
        for other in hosts:
            if one:
                assert key[other].startswith(key[one]) == (other == one or other.endswith("." + one))


def test_ties_empty_tables_and_bad_rules(spark):
    pages = spark.createDataFrame([(1, "http://x.net/ab"), (2, None)], "page_id long, url string")
    rules = [("net", "/ab", "allow"), ("x.net", "/", "block"), ("x.net", "/", "allow")]  # net/ab and x.net/ are equally long
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, spark.createDataFrame(rules, RULE)).collect()}
    assert got == {1: ("x.net/", "block"), 2: (None, "allow")}
    none = spark.createDataFrame([], RULE)
    assert {r.verdict for r in judge_urls(pages, none, "block").collect()} == {"block"}
    assert judge_urls(pages.limit(0), spark.createDataFrame(rules, RULE)).count() == 0
    for bad in (("net", "/", "deny"), ("", "/", "block"), (None, "/", "block"), ("net", "/", None)):
        with pytest.raises(ValueError):
            judge_urls(pages, spark.createDataFrame([bad], RULE))
    with pytest.raises(ValueError):
        judge_urls(pages, none, "maybe")
