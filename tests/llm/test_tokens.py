import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestack.llm import op1_tokens
from lodestack.llm.store import new_path
from lodestack.llm.tokenfile import Corrupt, Reader, Writer
from lodestack.llm.tokens import WordEncoder, by_words, read_documents, read_token_files, write_token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "İstanbul ΣΑΣ́ éé", "don't\tstop me now\r\n\x0b\x1c\x85x", "x<|endoftext|>y <|startoftext|>", "字" * 300, "a" * 5000, "́ lead", "1234 5,6!!", "𝔘nicode 😀😀", "'s 't I'LL we'Re", "Stop. STOP.. é, é.! ab1. 1a? x'. '. <|END.", "dig&&& Ab%%% x***. y### (z) [q], a<|endoftext|>b. c_d e@f 9$$ q<|endoftext|>; ab<| ab|>", "GROẞ Ǆ ŉ ﬁ Äß ªº µ Çà é.É,ñ!", "A<|startoftext|>. <|ENDOFTEXT|>"]


def brute(texts, end=2):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def encoded(encode, texts):
    ids, ends = encode.encode(pa.array(texts, pa.string()).slice(0))
    return [[*x.tolist(), 2] for x in np.split(ids, ends)[: len(texts)]]


def test_words_encode_as_whole_texts(spark, sf_dir):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    encode = WordEncoder(PATH)
    assert encoded(encode, texts) == brute(texts)
    plain = [x for x in texts if "<|" not in x]
    assert encoded(encode, plain) == brute(plain)


def test_memory_of_words_is_cleared(monkeypatch):
    import lodestack.llm.tokens as m

    monkeypatch.setattr(m, "CACHE_WORDS", 3)
    encode = WordEncoder(PATH)
    texts = ["a b c d e f g h", "b c zz yy xx a", "a" * 60 + " b"]
    for x in texts * 2:
        assert encoded(encode, [x]) == brute([x])
    assert encoded(encode, texts) == brute(texts)


def test_query_agrees_with_whole_encoding(spark, sf_dir):
    rows = sorted(op1_tokens.run(spark, sf_dir).collect())
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, []
    for (doc_id, _), ids in zip(docs, brute([t for _, t in docs]), strict=True):
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in rows] == want


def test_odd_rows(spark):
    rows = [(None, "null id", 1), (5, None, 2), (5, "twice", 3), (5, "twice", 3), (-1, "", 4)] + [(10 + i, x, 0) for i, x in enumerate(ODD)]
    path = new_path(spark, "t")
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string, ids_crc32 int"), path, PATH, 2, file_ids=50, frame_ids=7)
    got = read_token_files(spark, path).orderBy("part", "number", "at").collect()
    assert [r.doc_id for r in got] == [None, -1, 5, 5, 5, *range(10, 10 + len(ODD))]
    assert sorted(r.n_tokens for r in got) == sorted(map(len, brute([t for _, t, _ in rows])))
    assert len({(r.part, r.number) for r in got}) > 4
    some = {r.doc_id: r.ids for r in read_documents(spark, path, [11, 21]).collect()}
    assert some == {11: brute([" "])[0], 21: brute([ODD[11]])[0]}


def test_other_tokenizers_get_whole_texts(spark):
    """One that keeps case and joins blanks to words; each file's ids are those of the tokenizer on whole texts."""
    other = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(other)
    assert not by_words(tokenizer) and by_words(Tokenizer.from_file(PATH))
    with pytest.raises(ValueError):
        WordEncoder(other)
    path = new_path(spark, "t")
    write_token_files(spark.createDataFrame(list(enumerate([*ODD, None])), "doc_id long, text string"), path, other, None, file_ids=500)
    got = {r.doc_id: r.ids for r in read_documents(spark, path, list(range(len(ODD) + 1))).collect()}
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate([*ODD, None])}


def test_empty_table(spark):
    path = new_path(spark, "t")
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 2)
    assert read_token_files(spark, path).count() == 0


def test_frames_are_independent_and_checked():
    out = Writer(0, 0, 4, frame_ids=10)
    docs = [(i, np.arange(i, dtype="u4")) for i in range(30)]
    for d, ids in docs:
        out.add(d, ids)
    content = out.bytes()
    reader = Reader.of(content)
    assert [(d, x.tolist()) for d, x in reader.documents()] == [(d, x.tolist()) for d, x in docs]
    reader = Reader.of(content)
    assert [x.tolist() for _, x in reader.documents([25])] == [list(range(25))] and reader.unpacked == 2 < len(reader.entries)
    for at in (3, len(content) // 2, len(content) - 1, len(content) - 12):
        bad = bytearray(content)
        bad[at] ^= 0x55
        with pytest.raises(Corrupt):
            list(Reader.of(bytes(bad)).documents())


def test_starts_of_many_files_are_joined(spark, sf_dir, monkeypatch):
    small = sorted(map(tuple, op1_tokens.run(spark, sf_dir).collect()))
    monkeypatch.setattr(op1_tokens, "BROADCAST_FILES", 0)
    assert sorted(map(tuple, op1_tokens.run(spark, sf_dir).collect())) == small
    assert [r[1] for r in small] == [sum(x[2] for x in small[:i]) for i in range(len(small))]


def test_workers_encode_a_million_bytes_at_a_time():
    """With four million a worker peaked at 322 MB on check_l."""
    import lodestack.llm.tokens as m

    texts = ["ab cd. " * 30_000, None, "", "x" * 3_000_000, *["ef gh " * 1000] * 500]
    parts = list(m._chunks(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])))
    assert [i for ids, _ in parts for i in ids] == list(range(len(texts))) and [x for _, own in parts for x in own.to_pylist()] == texts
    assert all(len(ids) == 1 or sum(map(len, filter(None, own.to_pylist()))) <= 1_000_000 for ids, own in parts) and len(parts) < 10


def test_query_starts_no_workers_for_rows_of_the_driver(spark, sf_dir):
    assert "ExistingRDD" not in op1_tokens.run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
