import json

import pytest
from pyspark.sql import functions as F

from lodestack.operators import ingestion as I
from lodestack.sources import files as S


def test_normal_form_and_ocr(spark):
    docs = spark.createDataFrame([(1, "ﬁne​ “x” …\x07"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in I.normalised(docs).collect()} == {1: 'fine "x" ...', 2: None, 3: ""}
    got = spark.createDataFrame([("exam-\nple !!!!! -- a\n*\nb",)], "t string").select(I.ocr_cleaned(F.col("t"))).first()[0]
    assert got == "example ! -- a\nb"


def test_pages_boilerplate_and_sections(spark):
    page = "ACME Handbook {0}\n\n1 Scope\nbody of page {0} is here.\n1.1 Details\nmore {0}\n\nPage {0} of 3"
    text = "\n".join(f"<<<PAGE:{i}>>>\n" + page.format(i) for i in (1, 2, 3))
    docs = spark.createDataFrame([(1, text), (2, "Title\n\nACME Handbook 1\n\nPage 1 of 1"), (3, None)], "doc_id long, text string")
    rows = I.lines(docs)
    assert [r.page for r in rows.where("doc_id = 1 AND line LIKE 'body%'").orderBy("at").collect()] == [1, 2, 3]
    kept = I.without_boilerplate(rows)
    left = [r.line for r in kept.where("doc_id = 1 AND NOT blank").orderBy("at").collect()]
    assert not [x for x in left if x.startswith(("ACME", "Page"))]
    assert kept.where("doc_id = 2 AND NOT blank").count() == 3
    found = I.sections(I.headings(rows.where("doc_id = 1")))
    paths = {r.line: r.path for r in found.collect()}
    assert paths["more 2"][-2:] == ["1 Scope", "1.1 Details"] and paths["body of page 2 is here."][-1] == "1 Scope"
    parts = I.section_chunks(found, size=40).orderBy("chunk").collect()
    assert [p.chunk for p in parts] == list(range(len(parts))) and all(p.content for p in parts)
    assert I.paragraphs(rows.where("doc_id = 1")).count() >= 6


def test_greedy_chunks():
    s = [f"Sentence number {i} has some words." for i in range(40)]
    got = I.greedy_chunks(" ".join(s), 200, 80)
    assert all(len(c) <= 200 for c in got) and got[0].startswith(s[0]) and got[-1].endswith(s[-1])
    for a, b in zip(got, got[1:]):
        assert a.split(". ")[-1].rstrip(".") in b
    assert set(I.cut_sentences(" ".join(got))) == set(s)
    assert I.greedy_chunks("") == [] and I.greedy_chunks(None) == [] and I.greedy_chunks("x" * 5000) == ["x" * 5000]


def test_chunks_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = I.chunks(docs)
    want = {(r.doc_id, i): c for r in docs.collect() for i, c in enumerate(I.greedy_chunks(r.text))}
    assert {(r.doc_id, r.chunk): r.content for r in got.collect()} == want
    assert I.chunk_statistics(got).first().n == len(want)


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"plain \xff text")
    (tmp_path / "b.json").write_text(json.dumps({"k": [1, {"x": True}], "n": None, "s": {"t": "u"}}))
    (tmp_path / "c.json").write_text("{not json")
    (tmp_path / "d.exe").write_text("x")
    (tmp_path / "e.txt").write_text("")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "f.csv").write_text("id,name\n1,Ann\n2,\n")
    good, bad = S.accepted(S.listed(spark, str(tmp_path)))
    assert {r.name: r.reason for r in bad.collect()} == {"d.exe": "unsupported type"}
    assert S.texts(good).first().text == "plain � text"
    assert {r.name: r.text for r in S.jsons(good).collect()} == {"b.json": "k: 1\nx: true\nn: \nt: u", "c.json": "{not json"}
    assert S.csv_rows(spark, str(tmp_path / "t")).first().text == "id: 1, name: Ann\nid: 2, name: "
    assert S.fingerprint(good).first()[0] == S.fingerprint(good).first()[0]


def test_cases_are_validated(spark, tmp_path):
    case = {"id": "1", "question": "q", "expected_document": "d", "expected_chunks": [1]}
    (tmp_path / "ok.json").write_text(json.dumps([case, {**case, "id": "2"}]))
    (tmp_path / "twice.json").write_text(json.dumps([case, case]))
    assert S.load_cases(spark, str(tmp_path / "ok.json")).count() == 2
    with pytest.raises(ValueError):
        S.load_cases(spark, str(tmp_path / "twice.json"))
