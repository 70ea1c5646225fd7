import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestack.llm import op12_infilling
from lodestack.llm.infilling import GRAMMARS, boundary, fill_in_middle, neighbours, restored, units

ODD = [None, "", "a", "ab c", "  ", "\n", "x\r\ny", "naïve café №5", "emoji 😀😀 a😀b", "<P>", "a<S>b", "tail <M", "<<S", "<P", "a" * 3000, "é" * 3000, "Ab1cD2 " * 4000, "a\x00b", "line one\n\nline three\n"]


def brute(seed, doc_id, text, grammar=GRAMMARS["letters"]):
    text = text or ""
    u = re.findall(grammar, text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_query_agrees_with_sql(spark, sf_dir):
    rows = sorted(map(tuple, op12_infilling.run(spark, sf_dir).collect()))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert rows == sorted(c.sql(op12_infilling.SQL).fetchall())
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("grammar", sorted(GRAMMARS))
def test_units_are_the_grammars(spark, grammar):
    rows = spark.createDataFrame([(t,) for t in ODD], "text string").select("text", units(F.col("text"), GRAMMARS[grammar]).alias("u")).collect()
    ascii_words = re.ASCII if grammar == "words" else 0  # as Java reads \w and \s
    for r in rows:
        assert r.u == re.findall(GRAMMARS[grammar], r.text or "", ascii_words), (grammar, r.text)


def test_grammars_are_translated():
    assert neighbours(r"[A-Za-z]+|[^A-Za-z]") == [("[A-Za-z]", "[A-Za-z]")]
    assert neighbours(r"[^\n]*[\n]|[^\n]+") == [(r"[^\n]", r"[^\n]"), (r"[^\n]", r"[\n]")]
    assert boundary(r"[a]+").endswith(r"(?!(?<=[a])(?=[a]))")
    with pytest.raises(ValueError):
        boundary("abc")


def test_odd_rows(spark):
    rows = [(i, t, "kept", "x") for i, t in enumerate(ODD * 6)] + [(None, "no id", "kept", "x"), (7, "same id", "kept", "x"), (7, "same id", "kept", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string, form string")
    got = fill_in_middle(docs)
    assert got.columns == ["doc_id", "text", "_kept", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = got.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(1, r.doc_id, r.text)
        assert r.again == (r.text or "")
    assert fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(docs, plain_percent=101)


def test_other_seeds_grammars_and_shares(spark):
    docs = spark.createDataFrame([(i, "one line\nanother, longer line\n\nlast") for i in range(200)], "id long, body string")
    for grammar in ("lines", "characters"):
        for r in fill_in_middle(docs, 5, GRAMMARS[grammar], id_col="id", text_col="body").collect():
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(5, r.id, r.body, GRAMMARS[grammar])
    assert {r.form for r in fill_in_middle(docs, plain_percent=100, id_col="id", text_col="body").collect()} == {"plain"}
    assert {r.form for r in fill_in_middle(docs, plain_percent=0, suffix_first_percent=100, id_col="id", text_col="body").collect()} == {"spm"}
